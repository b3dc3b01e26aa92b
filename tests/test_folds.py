"""Folds dealt out over many tasks, against the same rules applied to one list after the other."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from gleaner import schema
from gleaner.config import Settings
from gleaner.functions import fixed as X
from gleaner.functions import text
from gleaner.operators import runs, settle


def off(a: str, b: str) -> bool:
    if len(a) == len(b):
        return len(a) > 1 and sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = (a, b) if len(a) > len(b) else (b, a)
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def settle_list(rows, group, mine, reach=12.0):
    """rows: dicts in order of seq, changed in place."""
    by = {}
    for r in rows:
        by.setdefault(tuple(r[k] for k in group), []).append(r)
    for company in by.values():
        n = Counter(r["amount"] for r in company)
        for r in company:
            if not mine(r) or not (n[r["amount"]] == 1 or not r["flags"]):
                continue
            own, k, best, votes = str(r["amount"]), n[r["amount"]], None, 0
            for other in [o["amount"] for o in company if abs(o["t"] - r["t"]) <= reach]:
                m = n[other]
                fits = m >= 2 and off(own, str(other)) if k == 1 else m >= 2 * k + 1 and own[:-1] == str(other)
                if fits and m > votes:
                    best, votes = other, m
            if best is not None:
                r["amount"] = best


def readings(seed: int, n: int, clips: int = 2):
    rng, t, out = random.Random(seed), 0.0, []
    for seq in range(n):
        t += rng.choice([0.0, 0.5, 0.5, 1.0, 3.0])
        amount = rng.choice([7, 12, 12, 12, 17, 123, 128, 41, 412, rng.randint(1, 999), rng.randint(1, 150)])
        kind, way = rng.choice(["hit", "hit", "heal"]), rng.choice(["in", "out"])
        fighter = rng.choice(["Ith", "Ith", "Karyna", "Unknown", None])
        out.append({"clip_id": f"c{rng.randrange(clips)}", "seq": seq, "t": round(t + rng.uniform(-2, 2), 1), "kind": kind, "dir": way, "fighter": fighter, "amount": amount, "flags": rng.choice([[], [], ["Torso"]])})
    return out


@pytest.mark.parametrize(("seed", "n", "reaches"), [(1, 700, 2), (2, 700, 3), (3, 400, 50)])
def test_settling_an_unbroken_clip_in_stretches(spark, seed, n, reaches):
    rows = readings(seed, n)
    frame = spark.createDataFrame([tuple(r.values()) for r in rows], "clip_id string, seq long, t double, kind string, dir string, fighter string, amount int, flags array<string>")
    got = {r["seq"]: r["amount"] for r in settle.settled(frame, reaches=reaches).collect()}
    named = [r for r in rows if r["fighter"]]
    settle_list(named, ("clip_id", "kind", "dir", "fighter"), lambda r: r["fighter"] != "Unknown")
    settle_list(named, ("clip_id",), lambda r: r["fighter"] == "Unknown")
    assert got == {r["seq"]: r["amount"] for r in rows} and len(got) == n


def test_a_chain_of_changes_crosses_stretches(spark):
    # each row yields to the one before it as that one has become, over many stretches
    rows = [("c", 0, 0.0, "hit", "out", "Ith", 55, ["Torso"]), ("c", 1, 1.0, "hit", "out", "Ith", 55, ["Torso"])]
    rows += [("c", i, 11.0 * i - 10, "hit", "out", "Ith", 550 + i, []) for i in range(2, 10)]
    frame = spark.createDataFrame(rows, "clip_id string, seq long, t double, kind string, dir string, fighter string, amount int, flags array<string>")
    expected = [dict(zip(frame.columns, r, strict=True)) for r in rows]
    settle_list(expected, ("clip_id", "kind", "dir", "fighter"), lambda r: True)
    assert {r["seq"]: r["amount"] for r in settle.settled(frame, reaches=2).collect()} == {r["seq"]: r["amount"] for r in expected}
    assert expected[-1]["amount"] == 55


def test_one_glyph_off_numbers(spark):
    df = spark.createDataFrame([(str(i),) for i in (0, 7, 10, 99, 123, 500)], "a string").select("a", F.explode(settle.near_numbers(F.col("a"))).alias("b"))
    every = [str(i) for i in range(10000)]
    got = {(r["a"], r["b"]) for r in df.collect() if not (r["b"].startswith("0") and r["b"] != "0")}
    assert got == {(a, b) for a in ("0", "7", "10", "99", "123", "500") for b in every if off(a, b)}


def rejoin_list(listed, horizon=24.0):
    """listed: (first, last, seconds) of one key's runs in order; the first run of each one's stretch."""
    out, held = [], None
    for i, (first, last, seconds) in enumerate(listed):
        adrift = held and not seconds and held[2] and first - held[1] <= horizon
        if held and (held[2] & seconds or adrift):
            held = (held[0], last, held[2] | seconds)
        else:
            held = (i, last, seconds)
        out.append(held[0])
    return out


@pytest.mark.parametrize("parts", [1, 5, 23])
def test_rejoining_over_parts(spark, parts):
    rng, rows, want = random.Random(parts), [], {}
    for key in ("a", "b", None):
        t, listed = 0.0, []
        for run in range(rng.choice([1, 40, 90])):
            t += rng.choice([13.0, 20.0, 24.0, 25.0, 60.0])
            seconds = set(rng.sample(range(max(0, run - 4), run + 3), rng.choice([0, 0, 1, 2])))
            listed.append((t, t + 2, {float(s) for s in seconds}))
            rows += [(key, run, t, None), (key, run, t + 2, None)] + [(key, run, t + 1, float(s)) for s in seconds]
            t += 2
        want |= {(key, i): s for i, s in enumerate(rejoin_list(listed))}
    df = spark.createDataFrame(rows, "k string, run long, read_at double, second double")
    got = runs.rejoined(df, ("k",), 24.0, parts).collect()
    assert len(got) == len(rows) and {(r["k"], r["run"]): r["stretch"] for r in got} == want


def event_list(rows, cfg):
    """The events of readings, as dicts, key by key."""
    by = {}
    for r in rows:
        by.setdefault((r["kind"], r["dir"], r["amount"], r["fighter"]), []).append(r)
    out = []
    for key, own in by.items():
        own.sort(key=lambda r: (r["ft"], r["t"], r["seq"]))
        listed = [[own[0]]]
        for a, b in zip(own, own[1:], strict=False):
            listed.append([b]) if b["ft"] - a["ft"] > cfg.visible else listed[-1].append(b)
        sec = lambda r: float(round(r["t"])) if r["exact"] else None
        to = rejoin_list([(x[0]["ft"], x[-1]["ft"], {sec(r) for r in x} - {None}) for x in listed], 2 * cfg.visible)
        stretches = {}
        for i, x in zip(to, listed, strict=True):
            stretches.setdefault(i, []).extend(x)
        for held in stretches.values():
            out += lines_of(key, held, sec, cfg)
    return [e for e in out if e["fighter"]]


def lines_of(key, held, sec, cfg):
    known = sorted((min(r["t"] for r in held if sec(r) == s), False, s) for s in {sec(r) for r in held} - {None})
    shown = Counter((r["ft"], r["pass"]) for r in held)
    most = max(shown.values())
    lines = list(known)
    for k in range(1, most + 1):
        at = min(ft for (ft, _), n in shown.items() if n >= k)
        if most > len(known) and len(lines) < most and all(abs(at - x[0]) > cfg.copy_apart for x in lines):
            lines.append((at, True, None))
    lines.sort(key=lambda x: (x[0], x[1], x[2] or 0))
    near = {}
    for r in held:
        if lines:
            near.setdefault(min(range(len(lines)), key=lambda i: (abs(lines[i][0] - r["t"]), i)), []).append(r)
    out = []
    for i, (at, bare, s) in enumerate(lines or [(None, True, None)]):
        mine = near.get(i, []) if lines else held
        source = [r for r in held if sec(r) == s] if not bare else mine or held
        basis = mine or source
        base = min(source, key=lambda r: (r["t"], r["ft"], r["seq"]))
        ranked = sorted(source, key=lambda r: (r["ft"], r["t"], r["seq"]))
        pool = [r for r in ranked if set(r["flags"]) <= set(X.TAGS)] or ranked
        tally = Counter(tuple(r["flags"]) for r in pool)
        flags = max(tally, key=lambda f: (tally[f], -next(i for i, r in enumerate(pool) if tuple(r["flags"]) == f)))
        times = [r["ft"] for r in basis]
        out.append({"kind": key[0], "dir": key[1], "amount": key[2], "fighter": key[3], "t": round(at, 1) if bare and at is not None else base["t"], "seq": base["seq"], "flags": list(flags), "seen": len(basis), "span": round(max(times) - min(times), 1), "last": max(times), "exact": base["exact"]})
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_events_with_tags_and_without_a_fighter(spark, seed):
    rng, rows, t = random.Random(seed), [], 0.0
    for seq in range(600):
        t += rng.choice([0.0, 0.0, 0.5, 0.5, 2.0, 14.0, 27.0])
        exact, fighter = rng.random() < 0.4, rng.choice(["Ith", "Ith", "Karyna", None, ""])
        rows.append({"seq": seq, "pass": rng.randrange(2), "ft": t, "t": round(t - rng.choice([0, 0.5, 1, 3]), 1) if exact else t, "exact": exact, "kind": "hit", "dir": rng.choice(["in", "out"]), "fighter": fighter, "amount": rng.choice([5, 7]), "flags": rng.choice([[], ["Torso"], ["Torso", "Parry"], ["Zork"], ["Parry", "Torso"]])})
    full = [("c", r["seq"], r["pass"], r["ft"], None, r["t"], r["exact"], r["kind"], r["dir"], r["fighter"] if r["dir"] == "in" else "You", "You" if r["dir"] == "in" else r["fighter"], r["fighter"], r["amount"], None, r["flags"], f"raw{r['seq']}") for r in rows]
    got = runs.events(spark.createDataFrame(full, schema.READING)).collect()
    names = ("kind", "dir", "amount", "fighter", "t", "seq", "flags", "seen", "span", "last", "exact")
    want = event_list(rows, Settings())
    assert sorted(str([r[n] for n in names]) for r in got) == sorted(str([e[n] for n in names]) for e in want)
    assert all(r["raw"] == f"raw{r['seq']}" and r["who" if r["dir"] == "in" else "target"] == r["fighter"] for r in got)


def test_tenths_of_a_million_numbers(spark):
    rng = random.Random(1)
    some = [rng.uniform(-1e4, 1e4) for _ in range(300_000)] + [round(rng.uniform(-500, 500), 2) for _ in range(400_000)] + [rng.randint(-10**6, 10**6) / 20 for _ in range(300_000)]
    some += [1.15, 0.05, 0.15, 0.25, 0.35, -0.25, 2.5, 0.0, -0.05, 86399.95, 1e15]
    import pandas as pd

    got = spark.createDataFrame(pd.DataFrame({"x": some})).select("x", text.tenths(F.col("x")).alias("y")).toPandas()
    assert (got["y"] == [round(x, 1) for x in got["x"]]).all()
