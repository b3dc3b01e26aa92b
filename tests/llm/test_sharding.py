import zlib

from gleaner.llm import sharding as sh


def test_assigned(docs, rows):
    got = sh.assigned(docs, shards=5).collect()
    want = sorted((str(r[0]), len((r[1] or "").encode()) + 16, zlib.crc32((r[1] or "").encode())) for r in rows)
    assert sorted((str(r.doc_id), r["size"], r.text_crc32) for r in got) == want
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r.slot)
        assert r.law == "bytes" and r.grown_shard is None
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    total = {}
    for r in got:
        total[r.shard] = total.get(r.shard, 0) + r["size"]
    slots = {}
    for r in got:
        slots[r.virtual_slot] = slots.get(r.virtual_slot, 0) + r["size"]
    assert set(total) == set(range(5)) and max(total.values()) - min(total.values()) <= max(slots.values())
    assert sorted(map(str, sh.assigned(docs, shards=5).collect())) == sorted(map(str, got))


def test_maps():
    load = {i: 100 + i % 37 for i in range(2000)}
    before = sh.new_map(load, 40, 2000)
    total = lambda m, n: [sum(load[s] for s in range(2000) if m[s] == k) for k in range(n)]
    assert max(total(before, 40)) - min(total(before, 40)) <= 136
    after = sh.grown(before, load)
    assert all(a in (b, 40) for a, b in zip(after, before, strict=True)) and min(total(after, 41)) > 0.9 * sum(load.values()) / 41
    load |= {s: 5 * load[s] for s in range(2000) if before[s] == 3}
    again = sh.rebalanced(before, load, 40)
    assert max(total(again, 40)) < 1.02 * sum(load.values()) / 40
    assert sum(a != b for a, b in zip(again, before, strict=True)) < 400


def test_stored_versions(spark, tmp_path):
    one, two = [0, 1, 2, 0], [0, 1, 2, 3]
    sh.save_map(spark, one, f"file://{tmp_path}/map", 1)
    sh.save_map(spark, two, f"file://{tmp_path}/map", 2)
    assert sh.load_map(spark, f"file://{tmp_path}/map", 1) == one and sh.load_map(spark, f"file://{tmp_path}/map", 2) == two


def test_empty(none):
    assert sh.assigned(none).count() == 0


def test_an_earlier_version_of_the_map_is_edited(spark, docs, tmp_path):
    maps = f"file://{tmp_path}/of-query"
    one = {(r.doc_id, r.text_crc32, r.slot): r.shard for r in sh.assigned(docs, 4, 64, maps).collect()}
    again = {(r.doc_id, r.text_crc32, r.slot): r.shard for r in sh.assigned(docs, 4, 64, maps, 1).collect()}
    assert again == one and sh.load_map(spark, maps, 2) == sh.load_map(spark, maps, 1)
    more = docs.unionByName(docs.limit(0)).where("doc_id < 50 or doc_id is null")
    moved = sh.assigned(more, 5, 64, maps, 2)
    first, third = sh.load_map(spark, maps, 1), sh.load_map(spark, maps, 3)
    assert moved.count() == more.count() and 0 < sum(a != b for a, b in zip(first, third)) < 64
