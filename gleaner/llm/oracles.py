"""SQL of the queries that SQL can express. The others are tested against brute force in tests/llm."""

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_LETTERS = rf"regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_EIGHT = " || ' ' || ".join(["x"] + [f"lead(x, {k}) over v" for k in range(1, 8)])

OP1 = rf"""with d as (select doc_id, coalesce(text, '') t, {_WORDS} w, [x for x in string_split(coalesce(text, ''), chr(10)) if regexp_matches(x, '[^\x20\x09-\x0D]')] l from documents),
  p as (select doc_id, unnest(range(len(w))) i, unnest(w) x from d where len(w) >= 8),
  o as (select doc_id, i, {_EIGHT} s from p window v as (partition by doc_id order by i)),
  q as (select doc_id, i, count(*) over (partition by doc_id, s) n from o where s is not null),
  r as (select doc_id, count(distinct j) n_repeat_words from (select doc_id, unnest(range(i, i + 8)) j from q where n > 1) group by 1),
  m as (select d.doc_id, cast(len(w) as bigint) n_words, cast(length(array_to_string(w, '')) as bigint) word_chars, cast(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as bigint) n_symbols,
    cast(len(l) as bigint) n_lines, cast(len(l) - len(list_distinct(l)) as bigint) n_dup_lines, cast(length(t) - length(regexp_replace(t, '\p{{Lu}}', '', 'g')) as bigint) n_upper,
    cast(length(t) - length(regexp_replace(t, '[!?]', '', 'g')) as bigint) n_exclaims, cast(coalesce(n_repeat_words, 0) as bigint) n_repeat_words from d left join r on d.doc_id = r.doc_id),
  b as (select *, cast((n_words < 20)::integer + 2 * (100 * n_repeat_words > 30 * n_words)::integer + 4 * (10 * n_symbols > 3 * n_words)::integer + 8 * (n_lines >= 4 and 2 * n_dup_lines > n_lines)::integer
    + 16 * (n_words > 0 and (word_chars < 2 * n_words or word_chars > 25 * n_words))::integer + 32 * (n_words > 0 and 2 * n_upper > word_chars)::integer + 64 * (n_words > 0 and 4 * n_exclaims > n_words)::integer as bigint) fail_bits from m)
  select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 20 or 100 * n_repeat_words > 30 * n_words base_failed, fail_bits = 0 kept, fail_bits, n_lines, n_upper, n_exclaims from b"""

RULE_ABLATIONS = f"""with r(policy, version, rule, bit, held) as (values
    ('base', 1, 'too_few_words', 1, 3), ('base', 1, 'repeated_windows', 2, 3),
    ('web', 1, 'too_few_words', 1, 15), ('web', 1, 'repeated_windows', 2, 15), ('web', 1, 'symbol_heavy', 4, 15), ('web', 1, 'repeated_lines', 8, 15),
    ('web', 2, 'too_few_words', 1, 127), ('web', 2, 'repeated_windows', 2, 127), ('web', 2, 'symbol_heavy', 4, 127), ('web', 2, 'repeated_lines', 8, 127),
    ('web', 2, 'odd_word_length', 16, 127), ('web', 2, 'shouting', 32, 127), ('web', 2, 'exclaiming', 64, 127))
  select policy, version, rule, count(*) filter (fail_bits & bit <> 0) failed, count(*) filter (fail_bits & held = bit) only_this, count(*) filter (fail_bits & held = 0) kept
  from ({OP1}) l, r group by policy, version, rule"""

# Base32 of the 40 hex digits: 20 bits are 5 of them, and 4 characters.
_DIGITS = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'"
_FOUR = " || ".join(f"substr({_DIGITS}, cast((n >> {shift}) & 31 as integer) + 1, 1)" for shift in (15, 10, 5, 0))
OP2 = rf"""with p as (select page_id, coalesce(html, '') h from pages), r as (select h, max(page_id) response_id, sha1(h) x from p group by h),
  g as (select h, response_id, [cast('0x' || substr(x, cast(5 * i + 1 as integer), 5) as bigint) for i in range(8)] l from r),
  b as (select h, response_id, array_to_string([{_FOUR} for n in l], '') payload_digest from g),
  o as (select page_id, p.h, payload_digest, response_id, page_id is not distinct from response_id is_response from p join b on p.h = b.h)
  select page_id, cast(octet_length(encode(h)) as bigint) payload_bytes, payload_digest, case when is_response then 'response' else 'revisit' end record_type,
    case when is_response then null else response_id end refers_to, cast(null as varchar) fault from o"""

OP5 = f"""with s as (select distinct item_id, array_to_string(list_slice(w, i + 1, i + 5), ' ') s from (select item_id, w, unnest(range(len(w) - 4)) i from (select item_id, {_LETTERS} w from benchmark) where len(w) >= 5)),
  d as (select distinct doc_id, array_to_string(list_slice(w, i + 1, i + 5), ' ') s from (select doc_id, w, unnest(range(len(w) - 4)) i from (select doc_id, {_LETTERS} w from documents) where len(w) >= 5)),
  n as (select item_id, count(*) n from s group by 1), m as (select doc_id, item_id, count(*) k from d join s on d.s = s.s group by 1, 2)
  select doc_id, m.item_id, round(k / n::double, 9) containment from m join n on m.item_id = n.item_id where k / n::double >= 0.8"""

OP10 = f"""with d as (select doc_id, {_WORDS} w from documents), p as (select doc_id, i, array_to_string(list_slice(w, i + 1, i + 13), ' ') s from (select doc_id, w, unnest(range(len(w) - 12)) i from d where len(w) >= 13)),
  q as (select doc_id, i, min(doc_id) over (partition by s) m from p), g as (select distinct doc_id, unnest(range(i, i + 13)) j from q where m < doc_id),
  x as (select doc_id, unnest(range(len(w))) j, unnest(w) x from d), y as (select x.doc_id, x.j, x, g.j is not null gone from x left join g on x.doc_id = g.doc_id and x.j = g.j),
  z as (select doc_id, count(*) filter (gone) n, coalesce(string_agg(x, ' ' order by j) filter (not gone), '') t from y group by 1)
  select d.doc_id, cast(len(w) as bigint) n_words, cast(coalesce(n, 0) as bigint) n_removed, sha256(coalesce(t, '')) kept_sha256 from d left join z on d.doc_id = z.doc_id"""

OP13 = rf"""with d as (select row_number() over () r, doc_id, {_LETTERS} l from documents), b as (select row_number() over () q, item_id, {_LETTERS} l from benchmark),
  t as (select count(*) filter (len(l) > 0) n_docs, sum(len(l)) n_terms from d), a as (select q, item_id, term, count(*) times from (select q, item_id, unnest(l) term from b) group by all),
  p as (select r, doc_id, n, term, count(*) tf from (select r, doc_id, len(l) n, unnest(l) term from d) semi join a using (term) group by all),
  w as (select term, cast(floor(1000 * ln((2.0::double * n_docs + 2) / (2.0::double * count(*) + 1))) as bigint) w from p, t group by term, n_docs),
  i as (select r, doc_id, term, (1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // n_terms)) impact from p, t),
  s as (select q, item_id, r, doc_id, cast(sum(times * w * impact) as bigint) score from a join w using (term) join i using (term) group by all)
  select item_id, cast(k as integer) rank, doc_id, score from (select *, row_number() over (partition by q order by score desc, doc_id) k from s where score > 0) where k <= 10"""

SQL = {"op1_quality_rules": OP1, "rule_ablations": RULE_ABLATIONS, "op2_warc": OP2, "op5_decontamination": OP5, "op10_substring_dedup": OP10, "op13_ranked_search": OP13}
