"""Queries of chained steps: all shapes of the grammar, settling, clocks, run assembly, sinks read back, each with its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from gleaner.config import Settings
from gleaner.functions import similarity, text
from gleaner.operators import clock, lines, names, prune, runs, settle
from gleaner.plans import catalogue as c
from gleaner.plans import reconstruct, report
from gleaner.sources import readers, sinks
from gleaner.sources.staging import shared_folder, staged

#: Lines of every shape, by event_id % len(LINES): text with {n} for the amount and {m} for it with letters for digits; the
#: condition on the amount for which the line is read; kind, dir, who, target, ability and tags; None where it is never read.
LINES = (
    ("Karyna's Lesser Heal heals you for {n}", "true", "heal", "in", "Karyna", "You", "Lesser Heal", ""),
    ("Lesser Heal heals you for {n}", "true", "heal", "in", "Unknown", "You", "Lesser Heal", ""),
    ("Your Lesser Heal heals Bigilo for {n}", "true", "heal", "out", "You", "Bigilo", "Lesser Heal", ""),
    ("You heal Bigilo for {n}", "true", "heal", "out", "You", "Bigilo", None, ""),
    ("Your Corrupt hit Soowon for {n} [Torso] [Head] [Torso]", "true", "hit", "out", "You", "Soowon", "Corrupt", "Torso,Head"),
    ("You hit Bigilo for {n}[Torso]", "true", "hit", "out", "You", "Bigilo", None, "Torso"),
    ("Ith's arrow hit you for {n}", "true", "hit", "in", "Ith", "You", "arrow", ""),
    ("Karyna~ arrow hit you for {n}", "true", "hit", "in", "Karyna", "You", "arrow", ""),
    ("Terror Bird deeply bites you for {n}[Head]", "true", "hit", "in", "TerrorBird", "You", None, "Head"),
    ("arrow bites you for {n}", "true", "hit", "in", "Unknown", "You", None, ""),
    ("[Combat] You hit Bigilo for {n}", "true", "hit", "out", "You", "Bigilo", None, ""),
    ("You hit Bigilo for {m}", "true", "hit", "out", "You", "Bigilo", None, ""),
    ("You hit Bigilo for {n}1Torso]", "amount < 100", "hit", "out", "You", "Bigilo", None, ""),
    ("You see a tree", None, None, None, None, None, None, ""),
    ("Bigilo waves for {n}", None, None, None, None, None, None, ""),
    ("Your Lesser Heal heals your cat for {n}", None, None, None, None, None, None, ""),
)


def _numbered(spark, sf_dir):
    """A line of LINES for each event; those whose id is divisible by 5 have no clock."""
    e = c._events(spark, sf_dir)
    said = F.element_at(F.array(*[F.lit(x[0]) for x in LINES]), (F.col("event_id") % len(LINES)).cast("int") + 1)
    n = F.col("amount").cast("string")
    said = F.replace(F.replace(said, F.lit("{n}"), n), F.lit("{m}"), F.translate(n, "015", "OlS"))
    raw = F.when(F.col("event_id") % 5 == 0, said).otherwise(F.concat(F.lit("["), F.date_format("ts", "HH:mm:ss"), F.lit("] "), said))
    return e.select("clip_id", F.col("event_id").cast("int").alias("frame_no"), F.col("sec").alias("ft"), F.lit(0).alias("pass"), F.lit(0).alias("line_no"), raw.alias("raw"))


def grammar_shapes(spark, sf_dir):
    got = reconstruct.readings(_numbered(spark, sf_dir))
    return got.select(F.floor(F.col("seq") / 10_000_000).alias("event_id"), "exact", "t", "kind", "dir", "who", "target", "fighter", "amount", "ability", F.array_join("flags", ",").alias("tags"))


def _with_gaps(spark, sf_dir):
    """The lines of _numbered with some repeated in their frame, some without a time and some without text."""
    log = _numbered(spark, sf_dir)
    n = F.col("frame_no")
    log = log.withColumn("raw", F.when(n % 7 == 0, F.lit(None)).when(n % 11 == 0, F.lit("[99:99:99 ")).when(n % 13 == 0, F.lit("You hit Bigilo for SSSSS")).otherwise(F.col("raw")))
    log = log.withColumn("ft", F.when(n % 17 == 0, None).otherwise(F.col("ft")))
    return log.unionByName(log.where(n % 3 == 0).withColumn("line_no", F.lit(1)).withColumn("raw", F.concat(F.lit(" "), "raw")))


def line_losses(spark, sf_dir):
    """What became of each clip's lines: readings, or the reason why not."""
    return lines.losses(_with_gaps(spark, sf_dir))


def _of(i: int) -> str:
    q = lambda v: "null" if v is None else "'" + v.replace("'", "''") + "'"
    return f"case event_id % {len(LINES)} " + " ".join(f"when {k} then {q(x[i])}" for k, x in enumerate(LINES)) + " end"


#: Why each of LINES is no reading, where it never is.
WHY = {13: "no amount", 14: "no shape", 15: "no shape"}
_READ = f"case event_id % {len(LINES)} " + " ".join(f"when {k} then {x[1] or 'false'}" for k, x in enumerate(LINES)) + " end"


def settle_fold(spark, sf_dir):
    """Amounts settled one after the other, named fighters' and then the unknown one's."""
    return settle.settled(_company(spark, sf_dir)).select("clip_id", "seq", "fighter", "amount")


def _company(spark, sf_dir):
    """Readings of few amounts in clips of two users, a second for each ten minutes."""
    e = c._events(spark, sf_dir)
    fighter = F.when(F.col("event_type") == "error", "Unknown").when(F.col("event_id") % 11 == 0, None).otherwise(F.col("event_type"))
    flags = F.when(F.col("event_id") % 4 == 0, F.array(F.lit("Torso"))).otherwise(F.array().cast("array<string>"))
    return e.select(
        F.floor(F.col("user_id") / 2).cast("string").alias("clip_id"), F.col("event_id").alias("seq"), "kind", "dir", fighter.alias("fighter"), F.round(F.col("sec") / 600, 1).alias("t"),
        (F.floor(F.pow(F.col("amount") % 31, F.lit(2)) / 7)).cast("int").alias("amount"), flags.alias("flags"),
    )


SQL_COMPANY = f"""(select cast(user_id // 2 as varchar) clip_id, event_id seq, kind, dir, case when event_type = 'error' then 'Unknown' when event_id % 11 = 0 then null else event_type end fighter,
  round(sec / 600, 1) t, cast(floor((amount % 31) * (amount % 31) / 7) as integer) amount, event_id % 4 = 0 tagged from {c.SQL_EVENTS})"""


def _fold_sql(p: str, source: str, by: str, mine: str) -> str:
    """CTEs of one fold: a group's rows as lists in order of reading, of which step i settles row i; its result is {p}r."""
    fits = """case when ns[i] = 1 then q.m >= 2 and levenshtein(cast(a[i] as varchar), cast(q.o as varchar)) = 1 and not (a[i] < 10 and q.o < 10)
        else q.m >= 2 * ns[i] + 1 and length(cast(a[i] as varchar)) = length(cast(q.o as varchar)) + 1 and starts_with(cast(a[i] as varchar), cast(q.o as varchar)) end"""
    others = "[struct_pack(m := ns[list_position(a0, a[j])], j := -j, o := a[j], near := abs(ts[j] - ts[i]) <= 12) for j in range(1, len(a) + 1)]"
    return f"""{p}c as (select *, count(*) over (partition by {by}, amount) n from {source}),
  {p}g as (select {by}, list(seq order by seq) sq, list(amount order by seq) a0, list(t order by seq) ts, list(n order by seq) ns, list(tagged order by seq) tg, list({mine} order by seq) mi from {p}c group by all),
  {p}f as (select {by}, 1 i, a0 a from {p}g union all select {by}, i + 1, case when best is null then a else list_concat(list_concat(a[1:i - 1], [best]), a[i + 1:]) end from
    (select {by}, i, a, case when mi[i] and (ns[i] = 1 or not tg[i]) then list_sort([q for q in {others} if q.near and {fits}], 'DESC')[1].o end best from {p}f join {p}g using ({by}) where i <= len(a))),
  {p}r as (select unnest(sq) seq, unnest(a) amount from {p}f join {p}g using ({by}) where i = len(a) + 1)"""


def clock_align(spark, sf_dir):
    """Timed readings moved onto the time of their clip by the middle offset of their recording."""
    got = clock.aligned(_timed(spark, sf_dir), Settings(apart=20_000.0, share=0.05))
    return got.select("clip_id", "seq", F.round("t", 1).alias("t"))


def _timed(spark, sf_dir):
    e = c._events(spark, sf_dir)
    exact = F.col("event_id") % 3 != 0
    ft = F.floor(F.col("sec") % 7000).cast("double")
    return e.select("clip_id", F.col("event_id").alias("seq"), F.when(exact, F.floor(F.col("sec") % 86400).cast("double")).otherwise(ft).alias("t"), ft.alias("ft"), exact.alias("exact"), "dir", "amount", F.nullif("event_type", F.lit("view")).alias("fighter"))


def runs_kept(spark, sf_dir):
    """Events from runs of readings, and whether noise filtering keeps them."""
    every = staged(runs.events(c._stand_in(spark, sf_dir)))
    last = c._stand_in(spark, sf_dir).groupBy("clip_id").agg(F.max("ft").alias("ends"))
    return prune.without_noise(every, last).select("clip_id", "t", "kind", "dir", "fighter", "amount", "seen", "span", "last")


def real_summary(spark, sf_dir):
    """The summary of a clip's steps, from lines to what noise filtering keeps, and the first of what it drops."""
    log = c._stand_in(spark, sf_dir).withColumn("frame_no", F.col("ft").cast("int"))
    clips = staged(log.groupBy("clip_id").agg(F.count_distinct("frame_no").alias("frames"), F.count("*").alias("lines"), F.count("*").alias("readings"), F.max("ft").alias("ends")))
    every = staged(runs.events(c._stand_in(spark, sf_dir)).select("clip_id", "t", "dir", "kind", "fighter", "amount", "last", "seen", "span", "exact"))
    judged = staged(prune.judged(every, clips.select("clip_id", "ends")).drop("seen", "span", "exact"))
    out = report.judged_summary(clips.drop("ends"), judged)
    return out.withColumn("first_dropped", F.array_join(F.coalesce("first_dropped", F.array().cast("array<string>")), ","))


_SECOND = "case when exact then round_even(t, 0) end"
_HIT = "clip_id, kind, dir, amount, fighter"
SQL_STAND_IN = f"""(select clip_id, event_id seq, cast(event_id % 2 as integer) pass, cast(round(sec / 1800 * 2) as bigint)::double ft, round(sec / 1800, 1) t, event_id % 3 = 0 exact, kind, dir, event_type fighter, amount % 4 amount from {c.SQL_EVENTS})"""
_RUNS = f"""r0 as (select *, {_SECOND} s, ft - lag(ft) over (partition by {_HIT} order by ft, t, seq) > 12 b from {SQL_STAND_IN}),
  r1 as (select *, coalesce(sum(b::integer) over (partition by {_HIT} order by ft, t, seq rows unbounded preceding), 0) run from r0),
  u as (select {_HIT}, run, min(ft) a, max(ft) z, list_distinct(list(s) filter (s is not null)) l from r1 group by all),
  v as (select {_HIT}, run, run id, z, coalesce(l, []) l from u where run = 0 union all select {_HIT}, run, case when j then id else run end, z1, case when j then list_concat(l, l1) else l1 end from
    (select v.{_HIT.replace(", ", ", v.")}, u.run, id, u.z z1, v.l, coalesce(u.l, []) l1, list_has_any(v.l, coalesce(u.l, [])) or len(coalesce(u.l, [])) = 0 and len(v.l) > 0 and u.a - v.z <= 24 j
     from v join u on {" and ".join(f"u.{k} = v.{k}" for k in _HIT.split(", "))} and u.run = v.run + 1)),
  w as (select r1.*, id stretch from r1 join v using ({_HIT}, run)),
  k as (select {_HIT}, stretch, s, min(t) at_ from w where s is not null group by all),
  f as (select {_HIT}, stretch, ft, max(n) n from (select {_HIT}, stretch, ft, pass, count(*) n from w group by all) group by all),
  most as (select {_HIT}, stretch, max(n) most from f group by all),
  first_k as (select {_HIT}, stretch, i, min(ft) at_ from (select *, unnest(range(1, n + 1)) i from f) group by all),
  base as (select most.*, coalesce(list(k.at_) filter (k.at_ is not null), []) times from most left join k using ({_HIT}, stretch) group by all),
  cp as (select {_HIT}, stretch, most, 0 i, times, len(times) m from base where most > len(times) union all select {_HIT}, stretch, most, cp.i + 1,
    case when len(times) < most and len([x for x in times if abs(at_ - x) <= 2.0]) = 0 then list_append(times, at_) else times end, m from cp join first_k using ({_HIT}, stretch) where first_k.i = cp.i + 1),
  extra as (select {_HIT}, stretch, unnest(times[m + 1:]) at_ from cp where i = most),
  ln as (select *, row_number() over (partition by {_HIT}, stretch order by at_, s is null, s) nth from (select {_HIT}, stretch, at_, s from k union all select {_HIT}, stretch, at_, null from extra)),
  near as (select w.*, nth from w join ln using ({_HIT}, stretch) qualify row_number() over (partition by seq order by abs(ln.at_ - w.t), nth) = 1),
  mine as (select {_HIT}, stretch, nth, count(*) seen, min(ft) a, max(ft) z, min(struct_pack(t := t, ft := ft, seq := seq)) b from near group by all),
  own as (select {_HIT}, stretch, s, count(*) seen, min(ft) a, max(ft) z, min(struct_pack(t := t, ft := ft, seq := seq)) b from w where s is not null group by all),
  ev as (select ln.{_HIT.replace(", ", ", ln.")}, case when ln.s is null then round_even(at_, 1) else own.b.t end t, coalesce(mine.seen, own.seen, every.seen) seen, round_even(coalesce(mine.z, own.z, every.z) - coalesce(mine.a, own.a, every.a), 1) span,
    coalesce(mine.z, own.z, every.z) last, case when ln.s is not null then true else (select any_value(exact) from w where w.seq = coalesce(mine.b.seq, every.b.seq)) end exact
    from ln left join mine using ({_HIT}, stretch, nth) left join own on {" and ".join(f"own.{x} = ln.{x}" for x in [*_HIT.split(", "), "stretch", "s"])}
    left join (select {_HIT}, stretch, count(*) seen, min(ft) a, max(ft) z, min(struct_pack(t := t, ft := ft, seq := seq)) b from w group by all) every on {" and ".join(f"every.{x} = ln.{x}" for x in [*_HIT.split(", "), "stretch"])})"""
_KEPT = """floor_ as (select clip_id, least(greatest(1, floor(percentile_disc(0.5) within group (order by seen desc) * 0.25)), 2) fl from ev group by 1),
  ends as (select clip_id, max(ft) ends from w group by 1),
  long_ as (select clip_id, percentile_disc(0.5) within group (order by span desc) * 0.25 lasted from ev join floor_ using (clip_id) where seen >= fl group by 1),
  kept as (select ev.* from ev join floor_ using (clip_id) left join long_ using (clip_id) join ends using (clip_id) where seen >= fl or exact and (coalesce(lasted, 0) > 0 and span >= lasted or last >= ends and seen >= 2))"""
_EVENT = "clip_id, t, kind, dir, fighter, amount, seen, span, last"


def roster_names(spark, sf_dir):
    """Names put right by a given roster; those unlike any of it become null."""
    e = c._events(spark, sf_dir)
    said = F.element_at(F.array(*[F.lit(x) for x in ("Karyna", "KARYNA", "Karvna9", "Bigi1o", "BigiIo", "Zzuxx", "zu", "Combatant", "Unknown")]), (F.col("event_id") % 9).cast("int") + 1)
    who, you = F.when(F.col("dir") == "in", said).otherwise("You"), F.when(F.col("dir") == "in", "You").otherwise(said)
    df = e.select("clip_id", F.col("event_id").alias("seq"), "dir", who.alias("who"), you.alias("target"))
    return names.canonical(df, Settings(roster=("Karyna", "Bigilo"))).select("seq", "who", "target", "fighter")


def likeness(spark, sf_dir):
    """The likeness of words to themselves with letters before or after, for which it has a closed form."""
    part = c._table(spark, sf_dir, "part").select("p_partkey", F.explode(F.split("p_name", " ")).alias("a"))
    b = F.when(F.col("p_partkey") % 3 == 0, F.concat("a", F.lit("QX"))).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("7"), F.col("a"))).otherwise(F.col("a"))
    return part.select("p_partkey", "a", b.alias("b")).withColumn("likeness", F.round(similarity.ratio(F.col("a"), F.col("b")), 6))


def baked_page(spark, sf_dir):
    """Pages with an envelope's JSON put before the end of their body, closing tags in it escaped."""
    p = c._table(spark, sf_dir, "pages")
    template = F.when(F.col("page_id") % 3 == 0, F.replace("html", F.lit("</body>"), F.lit(""))).otherwise(F.concat("html", F.lit("</body></html>")))
    json = F.concat(F.lit('{"url": "</script>'), F.col("url"), F.lit('"}'))
    return p.select("page_id", sinks.page(template, json).alias("page"))


def _fights(spark, sf_dir, cfg=Settings()):
    e = c._told(spark, sf_dir).withColumn("seq", F.col("amount").cast("long")).withColumn("t", F.floor(F.col("t") % 3000).cast("double"))
    null = lambda kind: F.lit(None).cast(kind)
    e = e.withColumns({"ft": F.col("t"), "exact": F.lit(True), "raw": F.lit(""), "pass": F.lit(0), "seen": F.lit(1).cast("long"), "span": F.lit(0.0), "last": F.col("t"), "wall_s": null("double")})
    clips = e.select("clip_id").distinct().select("clip_id", F.concat(F.lit("/videos/fight "), "clip_id", F.lit(".mp4")).alias("path"), F.lit(1920).alias("width"), F.lit(1080).alias("height"), F.lit(3000.25).alias("duration"))
    log = e.select("clip_id", F.col("t").cast("int").alias("frame_no"))
    return report.envelopes(e, clips, log, cfg)


def envelopes(spark, sf_dir):
    """A clip's envelope, paths left out, its events in order of time."""
    df = _fights(spark, sf_dir, Settings(no_path=True))
    told = F.array_join(F.transform("events", lambda x: F.concat_ws(":", x["t"].cast("long").cast("string"), x["dir"], x["amount"].cast("string"))), ",")
    return df.select("clip_id", "source", "source_path", "fps_sampled", "frames", "ocr_lines", F.array_join("players", ",").alias("players"), told.alias("events"))


def written_envelopes(spark, sf_dir):
    """Envelopes written as JSON, some of them again, and read back as hits of a report."""
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    df = staged(_fights(spark, sf_dir))
    sinks.write_envelopes(df, path)
    sinks.write_envelopes(df.where("clip_id like '%7'").withColumn("ocr", F.lit("again")), path)
    got = sinks.read_envelopes(spark, path).withColumn("name", text.stem(F.col("source")))
    hits = readers.hits_of(got).join(got.select("name", "ocr", "source_path", F.size("events").alias("n_events")), "name")
    return hits.select("name", "ocr", "source_path", "n_events", F.size("events").alias("n_hits"), F.aggregate("events", F.lit(0).cast("long"), lambda s, x: s + x["amount"]).alias("damage"))


def written_events(spark, sf_dir):
    """Events written by clip and read back."""
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    e = c._told(spark, sf_dir).withColumn("seq", F.col("amount").cast("long")).select("clip_id", "t", "dir", "kind", "amount", "seq")
    sinks.write_events(e.withColumn("amount", F.lit(-1)), path)
    sinks.write_events(e, path)
    return spark.read.schema("t double, dir string, kind string, amount int, seq long, clip_id string, part int").parquet(path).groupBy("clip_id", "dir", "kind").agg(F.count("*").alias("n"), F.sum("amount").alias("amount"))


def peek_visible(spark, sf_dir):
    """Whether the frames that are looked into show a log: a frame a minute of a day, its events' lines."""
    log = c._log(spark, sf_dir).withColumn("ft", F.floor(F.col("ft") % 86400 / 600).cast("double")).withColumn("frame_no", F.col("ft").cast("int"))
    clips = log.select("clip_id").distinct().withColumn("duration", F.lit(144.0))
    return lines.log_visible_at(log, clips, need=2)


def seen_between(spark, sf_dir):
    """Totals of a stretch of each clip without one fighter."""
    e = c._told(spark, sf_dir).withColumn("t", F.floor(F.col("t") % 86400).cast("double"))
    return report.selected(e, 20_000.0, 60_000.0, ("errorer",)).groupBy("clip_id").agg(F.count("*").alias("n"), F.min("t").alias("first"), F.max("t").alias("last"))


def clock_labels(spark, sf_dir):
    """When fights were saved, as their list shows it, the newest first."""
    e = c._events(spark, sf_dir)
    fights = e.groupBy("clip_id").agg(F.max("ts").alias("modified"), F.collect_list(F.struct("kind", "dir", "amount")).alias("events"), F.max(F.col("sec") % 5000).alias("duration"))
    return report.saved_history(fights.withColumnRenamed("clip_id", "name"))


def reader_lines(spark, sf_dir):
    """Lines that any reader of images finds, from the top and then from the left; where it fails there are none."""
    d = c._table(spark, sf_dir, "documents")
    images = d.select(F.lit("c").alias("clip_id"), F.col("doc_id").cast("int").alias("frame_no"), F.lit(0.0).alias("ft"), F.encode("text", "UTF-8").alias("content"))

    def reader(content: bytes):
        shown = content.decode()
        if len(shown) % 7 == 0:
            raise ValueError("no image")
        return [(float(len(line)), float(-i), line) for i, line in enumerate(shown.split("\n"))]

    return readers.read_frames(images, reader).select("frame_no", "line_no", F.md5("raw").alias("raw"))


def reader_faults(spark, sf_dir):
    """The frames that a reader fails on, and why."""
    d = c._table(spark, sf_dir, "documents")
    images = d.select(F.lit("c").alias("clip_id"), F.col("doc_id").cast("int").alias("frame_no"), F.lit(0.0).alias("ft"), F.encode("text", "UTF-8").alias("content"))

    def reader(content: bytes):
        if len(content) % 5 == 0:
            raise ValueError(f"{len(content)} bytes")
        return [(0.0, 0.0, "line")]

    return readers.read_frames_told(images, reader).where("fault is not null").select("frame_no", F.regexp_extract("fault", "^(\\w+)", 1).alias("kind"), F.regexp_extract("fault", "^ValueError: (.*)$", 1).alias("said"))


def sliced_frames(spark, sf_dir):
    """Frames of pages as clips of a character for each tenth of a second, read slice by slice, cropped to three characters of five."""
    p = c._table(spark, sf_dir, "pages").withColumn("html", F.coalesce("html", F.lit("")))
    clips = p.select(F.col("page_id").cast("string").alias("clip_id"), (F.length("html") / 10).alias("duration"), F.encode("html", "UTF-8").alias("path"))

    def opened(html, start, frames, fps, crop):
        shown, step = bytes(html).decode(), int(10 / fps)
        for i in range(frames):
            at = round(start * 10) + i * step
            if at < len(shown):
                yield shown[at + crop[0] : min(at + step, at + crop[0] + crop[2])].encode()

    got = readers.sampled_frames(clips, opened, 2.0, (1, 0, 3, 1))
    return got.groupBy("clip_id").agg(F.count("*").alias("frames"), F.max("ft").alias("last"), F.count_distinct("frame_no").alias("distinct_frames"), F.max(F.md5("content")).alias("largest"))


_LANGUAGE = "with recursive "
SQL: dict[str, str] = {
    "grammar_shapes": f"""select event_id, event_id % 5 <> 0 exact, case when event_id % 5 = 0 then sec else {c._WALL} end t, {_of(2)} kind, {_of(3)} dir, {_of(4)} who, {_of(5)} target,
      case when {_of(3)} = 'in' then {_of(4)} else {_of(5)} end fighter, amount, {_of(6)} ability, {_of(7)} tags from {c.SQL_EVENTS} where {_READ}""",
    "line_losses": f"""with x as (select *, event_id % 17 = 0 timeless, event_id % {len(LINES)} k from {c.SQL_EVENTS}),
      y as (select clip_id, case when event_id % 7 = 0 then 'no text' when timeless and (event_id % 11 = 0 or event_id % 13 = 0 or event_id % 5 = 0) then 'no time' when event_id % 11 = 0 then 'empty' when event_id % 13 = 0 then 'unreadable amount'
        when {_READ} then 'read' when k = 12 then 'unreadable amount' {" ".join(f"when k = {k} then '{why}'" for k, why in WHY.items())} end reason, 1 n from x union all select clip_id, 'repeated', 1 from x where event_id % 3 = 0)
      select clip_id, reason, cast(sum(n) as bigint) "lines" from y group by all""",
    "settle_fold": f"""{_LANGUAGE}x as (select * from {SQL_COMPANY}), {_fold_sql("n", "(select * from x where fighter is not null)", "clip_id, kind, dir, fighter", "fighter <> 'Unknown'")},
      y as (select x.* exclude (amount), nr.amount from x join nr using (seq)), {_fold_sql("s", "y", "clip_id", "fighter = 'Unknown'")}
      select clip_id, seq, fighter, coalesce(sr.amount, x.amount) amount from x left join sr using (seq)""",
    "clock_align": f"""with r as (select clip_id, event_id seq, event_id % 3 <> 0 exact, case when event_id % 3 <> 0 then floor(sec % 86400) else floor(sec % 7000) end t, floor(sec % 7000) ft, dir, amount, nullif(event_type, 'view') fighter from {c.SQL_EVENTS}),
      a as (select *, t - f o from (select clip_id, t, dir, amount, fighter, min(ft) f from r where exact group by all)), m as (select clip_id, percentile_disc(0.5) within group (order by o desc) mid from a group by 1),
      d as (select a.*, round_even((mid - o) / 86400.0, 0) * 86400.0 dy from a join m using (clip_id)), g as (select *, coalesce(o + dy - lag(o + dy) over w > 20000, false)::integer b from d window w as (partition by clip_id order by o + dy)),
      h as (select *, sum(b) over (partition by clip_id order by o + dy range unbounded preceding) grp from g), q as (select clip_id, grp, count(*) n, percentile_disc(0.5) within group (order by o + dy desc) centre from h group by all),
      e as (select *, n >= greatest(3, floor(sum(n) over (partition by clip_id) * 0.05)) ok, row_number() over (partition by clip_id order by n desc, grp) k from q),
      z as (select clip_id, list(centre order by centre) cs from (select * from e qualify ok or (not bool_or(ok) over (partition by clip_id) and k = 1)) group by 1),
      s as (select d.clip_id, t, dir, amount, fighter, dy, list_sort([struct_pack(f := abs(x - o - dy), c := x) for x in cs])[1].c centre from d join z using (clip_id))
      select r.clip_id, seq, round(case when exact and cs is not null then round_even(r.t + coalesce(dy, 0) - coalesce(centre, cs[len(cs) // 2 + 1]), 1) else r.t end, 1) t from r left join z using (clip_id)
      left join s on exact and s.clip_id = r.clip_id and s.t = r.t and s.dir = r.dir and s.amount = r.amount and s.fighter is not distinct from r.fighter""",
    "run_merge": f"{_LANGUAGE}{_RUNS} select {_EVENT} from ev",
    "runs_kept": f"{_LANGUAGE}{_RUNS}, {_KEPT} select {_EVENT} from kept",
    "real_summary": f"""{_LANGUAGE}{_RUNS}, {_KEPT}, a as (select clip_id, count(distinct ft) frames, count(*) "lines", count(*) readings from w group by 1), b as (select clip_id, count(*) folded from ev group by 1),
      d as (select clip_id, count(*) kept from kept group by 1), x as (select {_EVENT}, exact from ev except all select {_EVENT}, exact from kept),
      y as (select clip_id, string_agg(said, ',' order by k) first_dropped from (select clip_id, fighter || ':' || amount said, row_number() over (partition by clip_id order by t, dir, kind, fighter, amount, last) k from x) where k <= 6 group by 1)
      select a.*, coalesce(folded, 0) folded, coalesce(kept, 0) kept, coalesce(folded, 0) - coalesce(kept, 0) dropped, coalesce(first_dropped, '') first_dropped from a left join b using (clip_id) left join d using (clip_id) left join y using (clip_id)""",
    "roster_names": f"""with x as (select event_id seq, dir, case when event_id % 9 in (0, 1, 2) then 'Karyna' when event_id % 9 in (3, 4) then 'Bigilo' end fighter from {c.SQL_EVENTS})
      select seq, case when dir = 'in' then fighter else 'You' end who, case when dir = 'in' then 'You' else fighter end target, fighter from x""",
    "likeness": """select p_partkey, a, case p_partkey % 3 when 0 then a || 'QX' when 1 then '7' || a else a end b, round(2.0::double * length(a) / (2 * length(a) + case p_partkey % 3 when 0 then 2 when 1 then 1 else 0 end), 6) likeness
      from (select p_partkey, unnest(string_split(p_name, ' ')) a from part)""",
    "baked_page": """with x as (select page_id, case when page_id % 3 = 0 then replace(html, '</body>', '') else html || '</body></html>' end h, '<script>' || chr(10) || 'window.__BAKED__ = {"url": "<\\/script>' || replace(url, '</', '<\\/') || '"};' || chr(10) || '</script>' || chr(10) s from pages)
      select page_id, case when contains(h, '</body>') then substr(h, 1, instr(h, '</body>') - 1) || s || substr(h, instr(h, '</body>')) else h end page from x""",
    "envelopes": f"""with x as (select *, cast(floor(t % 3000) as bigint) s from {c.SQL_TOLD})
      select clip_id, 'fight ' || clip_id || '.mp4' as source, cast(null as varchar) source_path, 2.0::double fps_sampled, count(distinct s) frames, count(*) ocr_lines,
      array_to_string(list_sort(list_distinct([n for n in list_concat(list(who), list(target)) if n not in ('You', 'Unknown')])), ',') players,
      string_agg(s || ':' || dir || ':' || amount, ',' order by s, dir, amount, kind) events from x group by 1""",
    "written_envelopes": f"""select 'fight ' || clip_id as name, case when clip_id like '%7' then 'again' else 'given' end ocr, '/videos/fight ' || clip_id || '.mp4' source_path, cast(count(*) as integer) n_events,
      cast(count(*) filter (kind = 'hit') as integer) n_hits, cast(coalesce(sum(amount) filter (kind = 'hit'), 0) as bigint) damage from {c.SQL_TOLD} group by clip_id""",
    "written_events": f"select clip_id, dir, kind, count(*) n, cast(sum(amount) as bigint) amount from {c.SQL_TOLD} group by all",
    "peek_visible": f"""with l as (select clip_id, floor(sec % 86400 / 600) ft, event_type in ('purchase', 'click', 'signup') hit from {c.SQL_EVENTS}), s as (select distinct clip_id, nth from l, (select unnest([28.8, 57.6, 86.4, 115.2]) nth)),
      f as (select distinct s.clip_id, min(ft) ft from s join l on s.clip_id = l.clip_id and ft >= nth group by s.clip_id, nth), v as (select l.clip_id, count(*) filter (hit) >= 2 visible from l join f on l.clip_id = f.clip_id and l.ft = f.ft group by 1)
      select clip_id, coalesce(visible, false) visible from (select distinct clip_id from l) left join v using (clip_id)""",
    "seen_between": f"""select clip_id, count(*) n, min(s) first, max(s) last from (select clip_id, floor(t % 86400) s, case when dir = 'in' then who else target end f from {c.SQL_TOLD}) where s between 20000 and 60000 and f <> 'errorer' group by 1""",
    "clock_labels": f"""select clip_id as name, strftime(max(ts), '%d %b, %H:%M') "when", cast(floor(max(sec % 5000) / 60) as bigint) || ':' || lpad(cast(cast(floor(max(sec % 5000) % 60) as bigint) as varchar), 2, '0') length, cast(count(*) as integer) events,
      cast(coalesce(sum(case when dir = 'out' then amount else -amount end) filter (kind = 'hit'), 0) as bigint) net from {c.SQL_EVENTS} group by 1""",
    "sliced_frames": """select cast(page_id as varchar) clip_id, count(*) frames, max(k / 2.0::double) as last, count(distinct k) distinct_frames, max(md5(substr(html, cast(5 * k + 2 as integer), 3))) largest
      from (select page_id, html, unnest(range(cast(ceil(length(html) / 5.0) as bigint))) k from pages where html <> '') group by 1""",
    "reader_faults": """select cast(doc_id as integer) frame_no, case when text is null then 'TypeError' else 'ValueError' end kind, case when text is null then '' else octet_length(encode(text)) || ' bytes' end said
      from documents where text is null or octet_length(encode(text)) % 5 = 0""",
    "reader_lines": """with d as (select doc_id, string_split(text, chr(10)) l from documents where length(text) % 7 <> 0), x as (select doc_id, unnest(range(len(l))) i, unnest(l) raw from d)
      select cast(doc_id as integer) frame_no, cast(row_number() over (partition by doc_id order by length(raw), i desc) - 1 as integer) line_no, md5(raw) raw from x""",
}


def queries():
    return {name: globals()[name] for name in SQL if name in globals()}
