"""The library's operators as queries on the driver's tables, each with its SQL where SQL can say it.

The tables hold no combat log, so columns stand in: an event's user is the clip, its type the fighter, its value the amount.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleaner.config import Settings
from gleaner.functions import similarity, text
from gleaner.operators import clock, lines, names, prune, runs, settle, statistics
from gleaner.plans import reconstruct, report
from gleaner.sources import readers


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _events(spark, sf_dir) -> DataFrame:
    """events with ts in seconds, clip_id, kind, dir, fighter, amount."""
    df = _table(spark, sf_dir, "events")
    t = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return df.select(
        "event_id", "ts", "user_id", "event_type", "value", "props", t.alias("sec"), F.col("user_id").cast("string").alias("clip_id"),
        F.when(F.col("event_type") == "signup", "heal").otherwise("hit").alias("kind"), F.when(F.col("event_type").isin("purchase", "click"), "out").otherwise("in").alias("dir"),
        F.floor("value").cast("int").alias("amount"),
    )


SQL_EVENTS = """(select event_id, ts, user_id, event_type, value, props, epoch_us(ts) / 1e6 sec, cast(user_id as varchar) clip_id,
  case when event_type = 'signup' then 'heal' else 'hit' end kind, case when event_type in ('purchase', 'click') then 'out' else 'in' end dir,
  cast(floor(value) as integer) amount from events)"""

#: Lines as a log would show them, by event type.
SHAPES = {
    "purchase": ("You hit Bigilo for {n}[Torso]", "hit", "out", "You", "Bigilo", None),
    "click": ("Your Corrupt hit Soowon for {n}", "hit", "out", "You", "Soowon", "Corrupt"),
    "view": ("Karyna's Lesser Heal heals you for {n}", "heal", "in", "Karyna", "You", "Lesser Heal"),
    "error": ("Terror Bird deeply bites you for {n}[Head]", "hit", "in", "TerrorBird", "You", None),
    "signup": ("Ith's arrow hit you for {n}", "hit", "in", "Ith", "You", "arrow"),
}


def _log(spark, sf_dir) -> DataFrame:
    """A log line for each event: a user is a clip, and an hour of its time a frame second."""
    e = _events(spark, sf_dir)
    body = F.lit("")
    for kind, (shape, *_) in SHAPES.items():
        before, after = shape.split("{n}")
        body = F.when(F.col("event_type") == kind, F.concat(F.lit(before), F.col("amount").cast("string"), F.lit(after))).otherwise(body)
    raw = F.concat(F.lit("["), F.date_format("ts", "HH:mm:ss"), F.lit("] "), body)
    return e.select("clip_id", F.col("event_id").cast("int").alias("frame_no"), F.col("sec").alias("ft"), F.lit(0).alias("pass"), F.lit(0).alias("line_no"), raw.alias("raw"), "event_id")


def fight_history(spark, sf_dir):
    return report.history(_events(spark, sf_dir), ("user_id",))


def line_frequency(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    return lines.line_frequency(docs.select(F.explode(F.split("text", "\n")).alias("raw")))


def _doc_lines(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "raw"))


def first_distinct_line(spark, sf_dir):
    return lines.first_distinct(_doc_lines(spark, sf_dir), ("doc_id",), ("pos",))


def hms_extract(spark, sf_dir):
    log = _log(spark, sf_dir)
    return log.select("event_id", text.clock_seconds(F.col("raw")).alias("wall_s"), text.after_clock(F.col("raw")).alias("body"))


def parse_lines(spark, sf_dir):
    got = reconstruct.readings(_log(spark, sf_dir))
    return got.select("clip_id", F.floor(F.col("seq") / 10_000_000).alias("frame_no"), "wall_s", "exact", "kind", "dir", "who", "target", "amount", "ability", F.array_join("flags", ",").alias("tags"))


def norm_name(spark, sf_dir):
    part = _table(spark, sf_dir, "part")
    return part.select("p_partkey", text.norm(F.concat_ws(" ", "p_name", "p_brand")).alias("norm"), text.tidy_name(F.concat("p_name", F.lit("'s"), "p_brand")).alias("tidy"))


def weapon_words(spark, sf_dir):
    part = _table(spark, sf_dir, "part").select("p_partkey", F.explode(F.split("p_name", " ")).alias("word"))
    return part.select("p_partkey", "word", text.is_weapon(F.col("word")).alias("weapon"), text.is_junk(F.col("word")).alias("junk"))


def bracketed_words(spark, sf_dir):
    part = _table(spark, sf_dir, "part")
    line = F.concat(F.lit("for 5["), "p_type", F.lit("] ("), "p_name", F.lit(") {"), "p_brand", F.lit("}"))
    return part.select("p_partkey", F.array_join(similarity.bracketed(line), "|").alias("shown"))


def read_tags(spark, sf_dir):
    """Tags of damaged brackets."""
    part = _table(spark, sf_dir, "part")
    line = F.concat(F.lit("[Pany]["), "p_type", F.lit("][Arrnor Pierced]["), "p_name", F.lit("]"))
    return part.select("p_partkey", F.array_join(similarity.tags(line), "|").alias("tags"))


def json_filter(spark, sf_dir):
    k = F.get_json_object("props", "$.k").try_cast("int")
    return _events(spark, sf_dir).select("event_id", k.alias("k"), "kind").where("kind = 'hit' and k >= 50")


def upper_median(spark, sf_dir):
    return _table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(statistics.upper_median("l_extendedprice").alias("middle"))


def _seen(spark, sf_dir):
    return _events(spark, sf_dir).groupBy("clip_id", "event_type").agg(F.count("*").alias("seen"))


def noise_floor(spark, sf_dir):
    return statistics.noise_floor(_seen(spark, sf_dir), ("clip_id",), "seen", cap=5)


def keep_real(spark, sf_dir):
    """Noise left out of per-type sums: spans are hours between a user's first and last event of a type."""
    e = _events(spark, sf_dir).groupBy("clip_id", "event_type").agg(F.count("*").alias("seen"), F.round((F.max("sec") - F.min("sec")) / 3600, 1).alias("span"), F.max("sec").alias("last"))
    e = e.withColumn("exact", F.col("event_type") != "view")
    ends = _events(spark, sf_dir).groupBy("clip_id").agg(F.max("sec").alias("ends"))
    return prune.without_noise(e, ends, Settings(seen_cap=12, seen_share=0.9)).select("clip_id", "event_type", "seen", "span")


def gap_islands(spark, sf_dir):
    df = statistics.islands(_events(spark, sf_dir), ("user_id",), "sec", 6 * 3600, ("event_id",))
    return df.groupBy("user_id", "island").agg(F.count("*").alias("n"), F.min("event_id").alias("first_event"))


def _offsets(spark, sf_dir):
    return _events(spark, sf_dir).select("clip_id", F.floor("sec").cast("double").alias("off"))


def offset_clusters(spark, sf_dir):
    df = clock.centres(_offsets(spark, sf_dir), Settings(apart=20_000.0, share=0.05))
    return df.select("clip_id", F.posexplode("centres").alias("nth", "centre"))


def nearest_centre(spark, sf_dir):
    off = _offsets(spark, sf_dir)
    mid = clock.centres(off, Settings(apart=20_000.0, share=0.05))
    return off.join(mid, "clip_id").select("clip_id", "off", statistics.nearest_of(F.col("off"), F.col("centres")).alias("centre"))


def midnight_unwrap(spark, sf_dir):
    off = F.col("event_id") * 7919.0
    return _events(spark, sf_dir).select("event_id", text.day_shift(off, F.lit(5_000_000.0)).alias("day"))


def one_glyph_pairs(spark, sf_dir):
    q = _table(spark, sf_dir, "lineitem").select(F.col("l_quantity").cast("int").cast("string").alias("a")).distinct()
    b = q.withColumnRenamed("a", "b").withColumn("len", F.explode(F.array(*[F.length("b") + i for i in (-1, 0, 1)])))
    return q.join(b, F.length("a") == F.col("len")).where(text.one_glyph_off(F.col("a"), F.col("b"))).select("a", "b")


def settle_amounts(spark, sf_dir):
    li = _table(spark, sf_dir, "lineitem")
    df = li.select("l_suppkey", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), (F.col("l_orderkey") / 40).alias("t"), (F.col("l_extendedprice").cast("int") % 130).alias("amount"),
                   F.when(F.col("l_returnflag") == "R", F.array(F.lit("Torso"))).otherwise(F.array().cast("array<string>")).alias("flags"))
    return settle.settled_by_join(df, 12.0, ["l_suppkey"]).select("l_suppkey", "seq", "amount")


def nameless_anti_join(spark, sf_dir):
    e = _events(spark, sf_dir)
    df = e.select(F.lit("c").alias("clip_id"), (F.col("user_id") % 7).cast("string").alias("who0"), "event_id", (F.col("sec") / 600).alias("t"), "amount", "dir", "event_type")
    df = df.withColumn("who", F.when(F.col("event_type") == "error", "Unknown").otherwise(F.col("who0")))
    return prune.without_nameless_copies(df, 12.0).select("event_id", "who", "amount")


def twin_prune(spark, sf_dir):
    df = _table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_returnflag", F.col("l_quantity").cast("int").alias("amount")).agg(F.count("*").alias("seen"))
    df = df.withColumn("exact", F.lit(True)).withColumn("seq", F.col("amount"))
    return prune.without_twins(df, ("l_suppkey", "l_returnflag")).select("l_suppkey", "l_returnflag", "amount", "seen")


def majority_vote(spark, sf_dir):
    li = _table(spark, sf_dir, "lineitem").withColumn("seq", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return statistics.majority(li, ("l_suppkey",), "l_quantity", "seq")


def _told(spark, sf_dir):
    e = _events(spark, sf_dir)
    who = F.when(F.col("dir") == "in", F.when(F.col("event_type") == "view", "Unknown").otherwise(F.concat(F.col("event_type"), F.lit("er")))).otherwise("You")
    target = F.when(F.col("dir") == "in", "You").otherwise(F.concat(F.col("event_type"), F.lit("ed")))
    flags = F.when(F.col("amount") % 3 == 0, F.array(F.lit("Parry"))).when(F.col("amount") % 3 == 1, F.array(F.lit("Counter Reduced"), F.lit("Torso"))).otherwise(F.array().cast("array<string>"))
    ability = F.when(F.col("amount") % 5 == 0, "arrow").when(F.col("amount") % 5 == 1, "Corrupt")
    return e.select("clip_id", "kind", "dir", "amount", F.col("sec").alias("t"), who.alias("who"), target.alias("target"), flags.alias("flags"), ability.alias("ability"))


SQL_TOLD = f"""(select clip_id, kind, dir, amount, sec t, case when dir = 'in' then case when event_type = 'view' then 'Unknown' else event_type || 'er' end else 'You' end who,
  case when dir = 'in' then 'You' else event_type || 'ed' end target, amount % 3 flag, case when amount % 5 = 0 then 'arrow' when amount % 5 = 1 then 'Corrupt' end ability from {SQL_EVENTS})"""


def totals(spark, sf_dir):
    df = report.totals(_told(spark, sf_dir))
    return df.withColumn("healers", F.array_join("healers", ",")).withColumn("spells", F.array_join("spells", ","))


def players(spark, sf_dir):
    return report.players(_told(spark, sf_dir)).select("clip_id", F.array_join("players", ",").alias("players"))


def lanes(spark, sf_dir):
    e = _told(spark, sf_dir).withColumn("t", F.floor(F.col("t") % 86400).cast("double"))
    clips = e.select("clip_id").distinct().withColumn("duration", F.lit(86000.0))
    return report.lanes(e, clips).select("clip_id", "lane", "t", "pct", "at", "seek", "who")


def lane_counts(spark, sf_dir):
    return report.lane_counts(_told(spark, sf_dir))


def defence(spark, sf_dir):
    return report.defence(report.selected(_told(spark, sf_dir), without=("signuper",)))


def summary(spark, sf_dir):
    """Counts of each step; of readings, those parsed from the events' lines, and as folded and kept their incoming ones."""
    log = _log(spark, sf_dir)
    got = reconstruct.readings(log)
    return report.summary(log, got, got.where("dir = 'in'"), got.where("dir = 'in' and kind = 'hit'"))


def line_pitch(spark, sf_dir):
    df = _table(spark, sf_dir, "lineitem").select("l_suppkey", (F.col("l_orderkey") * 3).alias("top"))
    return statistics.line_pitch(df, ("l_suppkey",), "top", F.lit(14).cast("long"))


def log_column(spark, sf_dir):
    li = _table(spark, sf_dir, "lineitem")
    b = li.select(F.col("l_suppkey").cast("string").alias("clip_id"), (F.col("l_orderkey") % 900).cast("int").alias("x"), (F.col("l_partkey") % 700 * 7).cast("int").alias("y"), F.lit(300).alias("w"), F.lit(20).alias("h"))
    clips = _table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("clip_id"), F.lit(1920).alias("width"), F.lit(1080).alias("height"))
    return statistics.log_column(b, clips)


def frame_segments(spark, sf_dir):
    c = _table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("clip_id"), (F.abs("c_acctbal") / 100).alias("duration"))
    return readers.segments(c).select("clip_id", "segment", "first_frame", "frames")


def _tagged(spark, sf_dir):
    d = _doc_lines(spark, sf_dir)
    named = F.when(F.col("pos") % 3 == 0, F.concat(F.lit("##FILE f"), F.lpad(F.col("pos").cast("string"), 6, "0"), F.lit(".png")))
    return d.select("doc_id", "pos", F.coalesce(named, F.col("raw")).alias("line"))


def tagged_lines(spark, sf_dir):
    got = readers.from_tagged(_tagged(spark, sf_dir), 2.0, 0, ("doc_id",))
    return got.select("doc_id", "frame_no", "ft", "line_no", "raw")


def box_records(spark, sf_dir):
    li = _table(spark, sf_dir, "lineitem")
    first = F.when(F.col("l_returnflag") == "R", F.lit("x")).otherwise((F.col("l_orderkey") % 500).cast("string"))
    line = F.concat_ws(" ", first, F.col("l_partkey").cast("string"), F.lit("300"), F.lit("20"))
    said = F.concat(line, F.lit("\t"), F.when(F.col("l_linestatus") == "F", "You hit Bob for 5").otherwise("You see a tree"))
    return readers.boxes(li.select("l_orderkey", "l_linenumber", said.alias("line")), by=("l_orderkey", "l_linenumber"))


def log_visible(spark, sf_dir):
    log = _log(spark, sf_dir).withColumn("clip_id", F.concat("clip_id", F.lit("/"), F.date_format(F.timestamp_seconds("ft"), "dd")))
    return lines.log_visible(log)


def clip_range(spark, sf_dir):
    e = _told(spark, sf_dir).withColumn("t", F.floor(F.col("t") % 7200).cast("double"))
    clips = e.select("clip_id").distinct().withColumn("duration", (F.length("clip_id") * 1000).cast("double"))
    return prune.in_clip(e, clips).groupBy("clip_id").agg(F.count("*").alias("n"), F.max("t").alias("last"))


def first_sightings(spark, sf_dir):
    e = _events(spark, sf_dir)
    df = e.select("clip_id", F.floor(F.col("sec") / 86400).cast("double").alias("t"), "dir", "amount", F.col("event_type").alias("fighter"), F.col("sec").alias("ft"), (F.col("amount") % 4 != 0).alias("exact"))
    return clock.first_sightings(df)


def readings_of_name(spark, sf_dir):
    return lines.readings_of(_told(spark, sf_dir).withColumn("ft", F.col("t")).withColumn("seq", F.lit(0)), "SIGN").select("clip_id", "t", "who", "target", "amount")


def name_counts(spark, sf_dir):
    df = _told(spark, sf_dir).withColumn("seq", F.floor("t").cast("long"))
    return names.frequencies(df).select("clip_id", "name", "n", "first")


def escaped_html(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", text.html_escaped(F.col("html")).alias("html"), text.stem(F.col("url")).alias("stem"))


def fuzzy_names(spark, sf_dir):
    """Canonical names of parts' words."""
    p = _table(spark, sf_dir, "part")
    who = F.translate(F.get(F.split("p_name", " "), F.lit(1)), "l", "1")
    df = p.select(F.col("p_brand").alias("clip_id"), F.col("p_partkey").alias("seq"), F.when(F.col("p_partkey") % 9 == 0, who).otherwise(F.get(F.split("p_name", " "), F.lit(1))).alias("who"), F.lit("You").alias("target"))
    return names.name_map(names.frequencies(df))


def run_merge(spark, sf_dir):
    """Events from runs of readings, by array folds within each run; rejoining and copies are sequential, which has no SQL."""
    return runs.events(_stand_in(spark, sf_dir)).select("clip_id", "t", "kind", "dir", "fighter", "amount", "seen", "span", "last")


def _stand_in(spark, sf_dir):
    e = _events(spark, sf_dir)
    amount = F.col("amount") % 4
    return e.select(
        "clip_id", F.col("event_id").alias("seq"), (F.col("event_id") % 2).cast("int").alias("pass"), F.round(F.col("sec") / 1800 * 2).cast("long").cast("double").alias("ft"), F.lit(None).cast("double").alias("wall_s"),
        F.round(F.col("sec") / 1800, 1).alias("t"), (F.col("event_id") % 3 == 0).alias("exact"), "kind", "dir", F.lit("a").alias("who"), F.lit("b").alias("target"), F.col("event_type").alias("fighter"),
        amount.cast("int").alias("amount"), F.lit(None).cast("string").alias("ability"), F.array().cast("array<string>").alias("flags"), F.lit("").alias("raw"),
    )


def reconstruct_events(spark, sf_dir):
    """The whole way from lines to events, each user's log a clip."""
    log = _log(spark, sf_dir).drop("event_id")
    base = log.groupBy("clip_id").agg(F.min("ft").alias("__b"))
    log = log.join(base, "clip_id").withColumn("ft", F.round((F.col("ft") - F.col("__b")) * 2) / 2).drop("__b").select(*log.columns)
    clips = log.groupBy("clip_id").agg(F.max("ft").alias("duration"))
    return reconstruct.events(log, clips).select("clip_id", "t", "kind", "dir", "who", "target", "amount", "seen", "span")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines to events to the history of fights."""
    return report.history(reconstruct_events(spark, sf_dir))


_ISLANDS = f"""(select *, sum(b) over (partition by clip_id order by off, event_id rows unbounded preceding) grp from
  (select clip_id, event_id, floor(sec) off, case when floor(sec) - lag(floor(sec)) over (partition by clip_id order by floor(sec), event_id) > 20000 then 1 else 0 end b from {SQL_EVENTS}))"""
_CENTRES = f"""(select clip_id, centre from (select *, n >= greatest(3, floor(sum(n) over (partition by clip_id) * 0.05)) r, row_number() over (partition by clip_id order by n desc, grp) k from
  (select clip_id, grp, count(*) n, percentile_disc(0.5) within group (order by off desc) centre from {_ISLANDS} group by 1, 2))
  qualify r or (not bool_or(r) over (partition by clip_id) and k = 1))"""


def _case(i: int) -> str:
    return "case event_type " + " ".join(f"when '{k}' then " + ("null" if v[i] is None else "'" + str(v[i]).replace("'", "''") + "'") for k, v in SHAPES.items()) + " end"


_LOG = "'[' || strftime(ts, '%H:%M:%S') || '] ' || replace(" + _case(0) + ", '{n}', cast(amount as varchar))"
_WALL = "cast(hour(ts) * 3600 + minute(ts) * 60 + second(ts) as double)"
_LANE = "case when flag = 1 and dir = 'in' then 'counter' when flag = 0 and dir = 'in' then 'parried' when flag = 0 and dir = 'out' then 'gotparried' end"
_NORM = "replace(regexp_replace(translate(replace(replace(replace(replace(lower({}), 'rn', 'm'), 'cl', 'd'), 'vv', 'w'), 'vy', 'w'), '05821', 'osbzl'), '[^a-z]', '', 'g'), 'i', 'l')"
_WEAPONS = "('arrow','arrows','bolt','bolts','dagger','sword','axe','mace','spear','javelin','hammer','bow','blade','lance','club','staff','knife','pike','halberd','shield','fist','fists')"
_JUNK = "length({0}) < 3 or regexp_matches(lower({0}), 'combat|nave|local|global|say|yell|guild|party|whisper|help|trade') or not regexp_matches(lower({0}), '[aeiou]')"
_LINES = "(select doc_id, unnest(range(len(l))) pos, unnest(l) raw from (select doc_id, string_split(text, chr(10)) l from documents where text is not null))"

SQL: dict[str, str] = {
    "fight_history": f"""select user_id, o "out", i "in", n events, o - i net from (select user_id, cast(coalesce(sum(amount) filter (kind = 'hit' and dir = 'out'), 0) as bigint) o,
      cast(coalesce(sum(amount) filter (kind = 'hit' and dir = 'in'), 0) as bigint) i, count(*) n from {SQL_EVENTS} group by 1)""",
    "line_frequency": f"select trim(raw) line, count(*) n from {_LINES} group by 1",
    "first_distinct_line": f"select doc_id, pos, raw from (select *, row_number() over (partition by doc_id, trim(regexp_replace(raw, '\\s+', ' ', 'g')) order by pos) k from {_LINES}) where k = 1",
    "hms_extract": f"select event_id, {_WALL} wall_s, '] ' || replace({_case(0)}, '{{n}}', cast(amount as varchar)) body from {SQL_EVENTS}",
    "parse_lines": f"""select clip_id, event_id frame_no, {_WALL} wall_s, true exact, {_case(1)} kind, {_case(2)} dir, {_case(3)} who, {_case(4)} target, amount, {_case(5)} ability,
      case event_type when 'purchase' then 'Torso' when 'error' then 'Head' else '' end tags from {SQL_EVENTS}""",
    "norm_name": f"select p_partkey, {_NORM.format('p_name || chr(32) || p_brand')} norm, regexp_replace(p_name || '''s' || p_brand, '[^A-Za-z0-9_''-]', '', 'g') tidy from part",
    "weapon_words": f"select p_partkey, word, trim(lower(word), '''s') in {_WEAPONS} weapon, {_JUNK.format('word')} junk from (select p_partkey, unnest(string_split(p_name, ' ')) word from part)",
    "bracketed_words": "select p_partkey, case when length(p_type) between 2 and 19 then p_type || '|' else '' end || p_name as shown from part where not regexp_matches(p_brand, '^[A-Za-z0-9 .,''!-]*$') union all "
    "select p_partkey, p_type || '|' || p_name || '|' || p_brand from part where regexp_matches(p_brand, '^[A-Za-z0-9 .,''!-]*$')",
    "json_filter": f"select event_id, k, kind from (select event_id, cast(json_extract_string(props, '$.k') as integer) k, kind from {SQL_EVENTS}) where kind = 'hit' and k >= 50",
    "upper_median": "select l_returnflag, l_linestatus, percentile_disc(0.5) within group (order by l_extendedprice desc) middle from lineitem group by 1, 2",
    "noise_floor": f"select clip_id, typical, cast(least(greatest(1, floor(typical * 0.25)), 5) as bigint) floor from (select clip_id, percentile_disc(0.5) within group (order by seen desc) typical from (select clip_id, event_type, count(*) seen from {SQL_EVENTS} group by 1, 2) group by 1)",
    "keep_real": f"""with e as (select clip_id, event_type, count(*) seen, round((max(sec) - min(sec)) / 3600, 1) span, max(sec) last, event_type <> 'view' exact from {SQL_EVENTS} group by 1, 2),
      f as (select clip_id, least(greatest(1, floor(percentile_disc(0.5) within group (order by seen desc) * 0.9)), 12) floor from e group by 1), x as (select clip_id, max(sec) ends from {SQL_EVENTS} group by 1),
      l as (select e.clip_id, percentile_disc(0.5) within group (order by span desc) * 0.9 lasted from e join f on e.clip_id = f.clip_id where seen >= floor group by 1)
      select e.clip_id, event_type, seen, span from e join f on e.clip_id = f.clip_id left join l on e.clip_id = l.clip_id join x on e.clip_id = x.clip_id
      where seen >= floor or exact and (coalesce(lasted, 0) > 0 and span >= lasted or last >= ends and seen >= 2)""",
    "gap_islands": f"""select user_id, cast(island as bigint) island, count(*) n, min(event_id) first_event from (select *, sum(b) over (partition by user_id order by sec, event_id rows unbounded preceding) island from
      (select *, case when sec - lag(sec) over (partition by user_id order by sec, event_id) > 21600 then 1 else 0 end b from {SQL_EVENTS})) group by 1, 2""",
    "offset_clusters": f"select clip_id, cast(row_number() over (partition by clip_id order by centre) - 1 as integer) nth, centre from {_CENTRES}",
    "nearest_centre": f"select clip_id, off, centre from (select e.clip_id, floor(sec) off, centre, row_number() over (partition by event_id order by abs(centre - floor(sec)), centre) k from {SQL_EVENTS} e join {_CENTRES} c on e.clip_id = c.clip_id) where k = 1",
    "midnight_unwrap": "select event_id, cast(round_even((5000000.0::double - event_id * 7919.0::double) / 86400.0::double, 0) as bigint) as day from events",
    "one_glyph_pairs": "with q as (select distinct cast(cast(l_quantity as integer) as varchar) a from lineitem) select q.a, r.a b from q, q r where levenshtein(q.a, r.a) = 1 and not (length(q.a) = 1 and length(r.a) = 1)",
    "settle_amounts": """with x as (select l_suppkey, l_orderkey * 10 + l_linenumber seq, l_orderkey / 40.0 t, cast(floor(l_extendedprice) as integer) % 130 amount, l_returnflag = 'R' tagged from lineitem),
      y as (select *, count(*) over (partition by l_suppkey, amount) n from x),
      z as (select e.l_suppkey, e.seq, o.amount best, row_number() over (partition by e.l_suppkey, e.seq order by o.n desc, o.seq) k from y e join y o on e.l_suppkey = o.l_suppkey and abs(e.t - o.t) <= 12
        where case when e.n = 1 then o.n >= 2 and levenshtein(cast(e.amount as varchar), cast(o.amount as varchar)) = 1 and not (e.amount < 10 and o.amount < 10)
        else not e.tagged and o.n >= 2 * e.n + 1 and length(cast(e.amount as varchar)) = length(cast(o.amount as varchar)) + 1 and starts_with(cast(e.amount as varchar), cast(o.amount as varchar)) end)
      select y.l_suppkey, y.seq, coalesce(best, amount) amount from y left join z on y.l_suppkey = z.l_suppkey and y.seq = z.seq and k = 1""",
    "nameless_anti_join": f"""with d as (select event_id, case when event_type = 'error' then 'Unknown' else cast(user_id % 7 as varchar) end who, amount, dir, sec / 600 t from {SQL_EVENTS})
      select event_id, who, amount from d where not (dir = 'in' and who = 'Unknown' and exists (select 1 from d n where n.dir = 'in' and n.who <> 'Unknown' and n.amount = d.amount and abs(n.t - d.t) <= 12))""",
    "twin_prune": """with g as (select l_suppkey, l_returnflag, cast(l_quantity as integer) amount, count(*) seen from lineitem group by 1, 2, 3),
      b as (select *, first_value(seen) over w s, first_value(amount) over w a from g window w as (partition by l_suppkey, l_returnflag order by seen desc, amount))
      select l_suppkey, l_returnflag, amount, seen from b where not (seen * 2 < s and levenshtein(cast(amount as varchar), cast(a as varchar)) = 1 and not (amount < 10 and a < 10))""",
    "majority_vote": "select l_suppkey, l_quantity, votes from (select *, row_number() over (partition by l_suppkey order by votes desc, f) k from (select l_suppkey, l_quantity, count(*) votes, min(l_orderkey * 10 + l_linenumber) f from lineitem group by 1, 2)) where k = 1",
    "totals": f"""select clip_id, {", ".join(f"cast(coalesce(sum(amount) filter (kind = '{k}' and dir = '{d}'), 0) as bigint) {n}_{d}" for k, n in (("hit", "damage"), ("heal", "healing")) for d in ("out", "in"))},
      {", ".join(f"cast(coalesce(sum(amount) filter (kind = 'hit' and dir = '{d}' and ability = 'Corrupt'), 0) as bigint) magic_{d}" for d in ("out", "in"))},
      coalesce(string_agg(distinct who, ',' order by who) filter (kind = 'heal' and dir = 'in' and who <> 'Unknown'), '') healers, coalesce(max(ability) filter (kind = 'hit' and ability = 'Corrupt'), '') spells from {SQL_TOLD} group by 1""",
    "players": f"select clip_id, string_agg(distinct name, ',' order by name) players from (select clip_id, who as name from {SQL_TOLD} union all select clip_id, target from {SQL_TOLD}) where name not in ('You', 'Unknown') group by 1",
    "lanes": f"""with h as (select *, floor(t % 86400) s, max(floor(t % 86400)) over (partition by clip_id) m from {SQL_TOLD} where kind = 'hit')
      select clip_id, {_LANE} lane, s t, round(s / greatest(86000.0, m) * 100, 2) pct, cast(cast(floor(s / 60) as bigint) as varchar) || ':' || lpad(cast(cast(s % 60 as bigint) as varchar), 2, '0') as "at", greatest(0.0, s - 4) seek,
      case when dir = 'in' then who else target end who from h where {_LANE} is not null""",
    "lane_counts": f"select clip_id, {', '.join(f'count(*) filter ({_LANE} = {chr(39)}{k}{chr(39)}) {k}' for k in ('counter', 'parried', 'gotparried'))} from {SQL_TOLD} where kind = 'hit' group by 1",
    "defence": f"""select *, round(parried * 100 / hits, 2) parried_pct, round(countered * 100 / hits, 2) countered_pct from (select clip_id, dir, count(*) hits, count(*) filter (flag = 0) parried, count(*) filter (flag = 1) countered
      from {SQL_TOLD} where kind = 'hit' and (case when dir = 'in' then who else target end) <> 'signuper' group by 1, 2)""",
    "summary": f"""select clip_id, n frames, n "lines", n readings, i folded, k kept, i - k dropped from (select clip_id, count(*) n, count(*) filter (event_type in ('view', 'error', 'signup')) i,
      count(*) filter (event_type in ('error', 'signup')) k from {SQL_EVENTS} group by 1)""",
    "line_pitch": """with g as (select l_suppkey, l_orderkey * 3 - lag(l_orderkey * 3) over (partition by l_suppkey order by l_orderkey) d from lineitem),
      p as (select l_suppkey, percentile_disc(0.5) within group (order by d desc) pitch from g where d > 6 and d < 120 group by 1)
      select s.l_suppkey, coalesce(pitch, 14) pitch from (select distinct l_suppkey from lineitem) s left join p on s.l_suppkey = p.l_suppkey""",
    "log_column": """with b as (select cast(l_suppkey as varchar) clip_id, l_orderkey % 900 x, l_partkey % 700 * 7 y from lineitem),
      c as (select clip_id, percentile_disc(0.5) within group (order by x desc) common from b group by 1 having count(*) >= 4), n as (select b.* from b join c on b.clip_id = c.clip_id where abs(x - common) <= 240),
      g as (select clip_id, y - lag(y) over (partition by clip_id order by y) d from n), p as (select clip_id, percentile_disc(0.5) within group (order by d desc) pitch from g where d > 6 and d < 120 group by 1),
      a as (select n.clip_id, min(x) l, max(x) + 300 r, min(y) t, max(y) + 20 b, coalesce(any_value(pitch), 18) pitch from n left join p on n.clip_id = p.clip_id group by 1 having count(*) >= 4)
      select clip_id, cast(greatest(0, l - 16) as integer) cx, cast(greatest(0, t - 3 * pitch) as integer) cy, cast(floor(least(1920 - greatest(0, l - 16), greatest(r - greatest(0, l - 16) + 220, 998.4))) as integer) cw,
      cast(least(1080, b + pitch) - greatest(0, t - 3 * pitch) as integer) ch, cast(pitch as integer) pitch from a""",
    "frame_segments": """with c as (select cast(c_custkey as varchar) clip_id, abs(c_acctbal) / 100 d from customer), n as (select *, cast(case when d >= 20 then least(greatest(floor(d / 10), 1), 4) else 1 end as integer) n from c),
      f as (select *, cast(ceil(d * 2 / n) as integer) frames from n) select clip_id, cast(s as integer) segment, cast(s * frames + 1 as integer) first_frame, frames from (select *, unnest(range(n)) s from f)""",
    "tagged_lines": f"select doc_id, cast(pos - pos % 3 as integer) frame_no, (pos - pos % 3 - 1) / 2.0::double ft, cast(pos as integer) line_no, trim(raw) raw from {_LINES} where pos % 3 <> 0 and trim(raw) <> ''",
    "box_records": "select l_orderkey, l_linenumber, cast(l_orderkey % 500 as integer) x, cast(l_partkey as integer) y, 300 w, 20 h, 'You hit Bob for 5' as text from lineitem where l_linestatus = 'F' and l_returnflag <> 'R'",
    "log_visible": f"select clip_id || '/' || strftime(ts, '%d') clip_id, count(*) filter (event_type in ('purchase', 'click', 'signup')) >= 3 visible from {SQL_EVENTS} group by 1",
    "clip_range": f"select clip_id, count(*) n, max(floor(t % 7200)) last from {SQL_TOLD} where floor(t % 7200) <= length(clip_id) * 1000 + 5 group by 1",
    "first_sightings": f"select clip_id, floor(sec / 86400) t, dir, amount, event_type fighter, min(sec) first_ft from {SQL_EVENTS} where amount % 4 <> 0 group by 1, 2, 3, 4, 5",
    "readings_of_name": f"select clip_id, t, who, target, amount from {SQL_TOLD} where contains(lower(who || target), 'sign')",
    "name_counts": f"select clip_id, name, count(*) n, min(a) first from (select clip_id, who as name, cast(floor(t) as bigint) * 2 a from {SQL_TOLD} union all select clip_id, target, cast(floor(t) as bigint) * 2 + 1 from {SQL_TOLD}) where name <> 'You' and not ({_JUNK.format('name')}) group by 1, 2",
    "escaped_html": "select page_id, replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;') html, regexp_replace(regexp_replace(url, '^.*[/\\\\]', ''), '\\.[^.]*$', '') stem from pages",
}

NAMES = (
    "fight_history", "line_frequency", "first_distinct_line", "hms_extract", "parse_lines", "norm_name", "weapon_words", "bracketed_words", "read_tags", "json_filter", "upper_median", "noise_floor", "keep_real",
    "gap_islands", "offset_clusters", "nearest_centre", "midnight_unwrap", "one_glyph_pairs", "settle_amounts", "nameless_anti_join", "twin_prune", "majority_vote", "totals", "players", "lanes", "lane_counts", "defence", "summary", "line_pitch",
    "log_column", "frame_segments", "tagged_lines", "box_records", "log_visible", "clip_range", "first_sightings", "readings_of_name", "name_counts", "escaped_html", "fuzzy_names", "run_merge", "reconstruct_events",
)


def queries():
    from gleaner.plans import chains, likeness

    return {name: globals()[name] for name in NAMES} | chains.queries() | likeness.queries()


def oracle_sql():
    from gleaner.plans import chains, likeness

    return SQL | chains.SQL | likeness.SQL
