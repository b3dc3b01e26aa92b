"""SQL of the queries that go by likeness: matching blocks and the greedy keeping of names as recursive queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleaner.functions import fixed as X
from gleaner.functions import similarity, text
from gleaner.plans import catalogue as c

_BEST = """list_sort(flatten([[struct_pack(k := len([l for l in range(1, least(ah - i, bh - j) + 1) if substr(a, cast(i + 1 as integer), cast(l as integer)) = substr(b, cast(j + 1 as integer), cast(l as integer))]), i := -i, j := -j)
      for j in range(bl, bh)] for i in range(al, ah)]), 'DESC')[1]"""


def blocks_sql(pairs: str) -> str:
    """CTEs of the likeness of pairs (a, b): stretches of both with their longest block, of equals the first in a and then in b; the result is lk (a, b, likeness)."""
    return f"""pr as (select distinct a, b from {pairs}),
  iv as (select *, {_BEST} m from (select a, b, cast(0 as bigint) al, length(a) ah, cast(0 as bigint) bl, length(b) bh from pr) union all
    select a, b, al, ah, bl, bh, {_BEST} m from (select a, b, x.al, x.ah, x.bl, x.bh from (select a, b, unnest([struct_pack(al := al, ah := -m.i, bl := bl, bh := -m.j), struct_pack(al := -m.i + m.k, ah := ah, bl := -m.j + m.k, bh := bh)]) x from iv where m.k > 0)
      where x.ah > x.al and x.bh > x.bl)),
  lk as (select a, b, 2.0::double * sum(coalesce(m.k, 0)) / (length(a) + length(b)) likeness from iv group by a, b)"""


def _shown(spark, sf_dir):
    return c._table(spark, sf_dir, "part").select("p_partkey", F.split(F.concat_ws(" ", "p_name", "p_brand", "p_type"), " ").alias("words"))


def _words(spark, sf_dir):
    return _shown(spark, sf_dir).select("p_partkey", F.posexplode("words").alias("at", "word"))


def likeness_pairs(spark, sf_dir):
    """The likeness of each part's words to those of the part before it.

    Parts meet with all their words, so that what is held is a row a part; they are dealt out in as many parts as the session
    sets, as they are few bytes and much work.
    """
    p = _shown(spark, sf_dir)
    p = p.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "p_partkey")
    other = _shown(spark, sf_dir).select((F.col("p_partkey") + 1).alias("p_partkey"), F.col("words").alias("others"))
    met = p.join(other, "p_partkey").select("p_partkey", F.posexplode(F.arrays_zip("words", "others")).alias("at", "x"))
    met = met.select("p_partkey", "at", F.col("x.words").alias("word"), F.col("x.others").alias("other")).where("word is not null and other is not null")
    return met.select("p_partkey", "at", "word", "other", F.round(similarity.ratio("word", "other"), 9).alias("likeness"))


def norm_keys(spark, sf_dir):
    """The folded form of parts' words, by which names are compared, and how many parts have each."""
    return _words(spark, sf_dir).select(text.norm(F.col("word")).alias("norm")).groupBy("norm").agg(F.count("*").alias("n"))


_W = "(select p_partkey, unnest(range(len(w))) at_, unnest(w) word from (select p_partkey, string_split(p_name || ' ' || p_brand || ' ' || p_type, ' ') w from part))"
_CUT = "case when contains(lower({0}), lower({1})) and length({0}) - strpos(reverse(lower({0})), reverse(lower({1}))) - length({1}) + 2 > 1 then regexp_matches(substr({0}, length({0}) - strpos(reverse(lower({0})), reverse(lower({1}))) - length({1}) + 2, 1), '^[a-z]') else regexp_matches({1}, '^[a-z]') end"
_LISTED = lambda words: ", ".join("'" + w.replace("'", "''") + "'" for w in words)
_TAGS = f"(select unnest([{_LISTED(X.TAGS)}]) tag)"
_SHOWN = """(select p_partkey, at_, trim(regexp_replace(shown, '\\s+', ' ', 'g')) shown from (select p_partkey, unnest([1, 2, 3, 4]) at_, unnest(['Pany', p_type, 'Arrnor Pierced', p_name]) shown from part)
  where regexp_matches(shown, '^[A-Za-z0-9 .,''!-]{2,19}$'))"""

SQL = {
    "likeness_pairs": f"""with recursive w as (select * from {_W}), j as (select w.p_partkey, w.at_, w.word, o.word other from w join w o on o.p_partkey + 1 = w.p_partkey and o.at_ = w.at_), {blocks_sql("(select other a, word b from j)")}
      select p_partkey, cast(at_ as integer) "at", word, other, round(likeness, 9) likeness from j join lk on a = other and b = word""",
    "norm_keys": f"select norm, count(*) n from (select {c._NORM.format('word')} norm from {_W}) group by 1",
    "fuzzy_names": f"""with recursive p as (select p_brand clip_id, p_partkey seq, case when p_partkey % 9 = 0 then replace(string_split(p_name, ' ')[2], 'l', '1') else string_split(p_name, ' ')[2] end who from part),
  n as (select clip_id, who as name, count(*) n, min(seq * 2) f, {c._NORM.format("who")} k from p where who is not null and who <> 'You' and not ({c._JUNK.format("who")}) group by all),
  fair as (select *, row_number() over (partition by clip_id order by n desc, f, name) r from (select *, max(n) over (partition by clip_id) most, row_number() over (partition by clip_id order by n desc, f, name) nth from n) where n >= 3 or most < 3 and nth = 1),
  {blocks_sql("(select fair.k a, n.k b from fair join n using (clip_id))")},
  cf as (select x.clip_id, x.r, list(y.r) filter (y.r is not null) l from fair x left join (select y.*, z.r of_, likeness from fair y join fair z on y.clip_id = z.clip_id and y.r < z.r join lk on lk.a = y.k and lk.b = z.k
    where likeness >= 0.86 or y.n >= z.n * 5 and (starts_with(y.k, z.k) or ends_with(y.k, z.k) and {_CUT.format("y.name", "z.name")})) y on y.clip_id = x.clip_id and y.of_ = x.r group by all),
  fold as (select clip_id, cast(0 as bigint) r, cast([] as bigint[]) kept from (select distinct clip_id from fair) union all
    select fold.clip_id, cf.r, case when len(list_intersect(kept, coalesce(l, []))) > 0 then kept else list_append(kept, cf.r) end from fold join cf on fold.clip_id = cf.clip_id and cf.r = fold.r + 1),
  anchor as (select fair.* from fair join (select clip_id, max_by(kept, r) kept from fold group by 1) z on fair.clip_id = z.clip_id and list_contains(kept, fair.r)),
  best as (select n.clip_id, n.name, a.name canonical, row_number() over (partition by n.clip_id, n.name order by likeness desc, a.k desc) nth from n join anchor a using (clip_id) join lk on lk.a = a.k and lk.b = n.k where likeness >= 0.55)
  select n.clip_id, n.name reading, canonical from n left join best on n.clip_id = best.clip_id and n.name = best.name and nth = 1""",
    "read_tags": f"""with recursive s as (select *, {c._NORM.format("shown")} k from {_SHOWN}), t as (select tag, {c._NORM.format("tag")} k from {_TAGS}), ch as (select {c._NORM.format("word")} k from (select unnest([{_LISTED(X.CHANNELS)}]) word)),
  d as (select distinct k from s where k <> '' and k not in (select k from ch) and k not in (select k from t)), {blocks_sql("(select t.k a, d.k b from t, d where 2.0 * least(length(t.k), length(d.k)) / (length(t.k) + length(d.k)) >= 0.66 union all select ch.k, d.k from ch, d where 2.0 * least(length(ch.k), length(d.k)) / (length(ch.k) + length(d.k)) >= 0.7)")},
  near as (select b k, tag, t.k tk from (select *, row_number() over (partition by b order by likeness desc, a desc) nth from lk where likeness >= 0.66 and a in (select k from t)) join t on a = t.k where nth = 1),
  channel as (select distinct b k from lk where likeness >= 0.7 and a in (select k from ch)),
  r as (select s.*, case when s.k = '' or s.k in (select k from ch) then null else coalesce(t.tag, case when not (contains(s.k, near.tk) and length(s.k) >= length(near.tk) + 2) then near.tag end,
    case when s.k not in (select k from channel) and regexp_matches(shown, '^[A-Za-z ]*$') then shown end) end tag from s left join t on s.k = t.k left join near on s.k = near.k),
  f as (select p_partkey, tag, min(at_) m from r where tag is not null group by all)
  select p_partkey, coalesce(string_agg(tag, '|' order by m), '') tags from part left join f using (p_partkey) group by 1""",
}


def queries():
    return {"likeness_pairs": likeness_pairs, "norm_keys": norm_keys}
