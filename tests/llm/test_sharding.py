import binascii

from gneiss.llm import sharding as sh


def laws(rows, got, shards):
    assert len(got) == len(rows)
    size = lambda t: len((t or "").encode()) + 16
    want = sorted((str(i), size(t), binascii.crc32((t or "").encode())) for i, t in rows)
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in got) == want
    total, most = sum(x[1] for x in want), max((x[1] for x in want), default=0)
    for s in range(shards):
        mine = [r for r in got if r["shard"] == s]
        assert sorted(r["slot"] for r in mine) == list(range(len(mine)))
        if rows:
            assert abs(sum(r["size"] for r in mine) - total / shards) <= 2 * most + 2 * sh.WHOLE_GROUP * total / shards
    assert all(r["law"] == "bytes" and r["grown_shard"] is None and 0 <= r["shard"] < shards for r in got)


def test_near_equal_bytes_with_a_hot_group(make, prose):
    rows = [(i, prose(10 + i % 50, i)) for i in range(600)] + [(1000 + i, "one text of many copies") for i in range(300)] + [(5000, None), (5001, ""), (None, "x"), (None, "x"), (7, "again"), (7, "again"), (8, prose(400, 3))]
    for shards in (4, 40):
        laws(rows, sh.shard_by_size(make(rows), shards).collect(), shards)


def test_small_groups_share_a_shard(make, prose):
    rows = [(i, prose(30, i)) for i in range(2000)] + [(3000 + i, f"copy {i % 100}") for i in range(300)]
    got = sh.shard_by_size(make(rows), 5).collect()
    for k in range(100):
        assert len({r["shard"] for r in got if r["doc_id"] >= 3000 and (r["doc_id"] - 3000) % 100 == k}) == 1


def test_few_rows_and_none(make):
    for rows in ([], [(1, "a")], [(1, None), (1, None)], [(i, "same") for i in range(50)]):
        laws(rows, sh.shard_by_size(make(rows), 8).collect(), 8)


def test_overfull_ranges_are_subdivided(make, monkeypatch):
    monkeypatch.setattr(sh, "OVERFULL", 1)
    rows = [(i, "hot") for i in range(400)] + [(1000 + i, f"t{i}") for i in range(200)]
    laws(rows, sh.shard_by_size(make(rows), 6).collect(), 6)


def test_groups_in_subdivided_ranges_stay_together(make, monkeypatch):
    monkeypatch.setattr(sh, "OVERFULL", 0.05)
    monkeypatch.setattr(sh, "WHOLE_GROUP", 0.1)
    rows = [(i, f"group {i % 150}") for i in range(1200)]
    docs = make(rows)
    for shards in (2, 3, 5, 7):
        got = sh.shard_by_size(docs, shards).collect()
        laws(rows, got, shards)
        for k in range(150):
            assert len({r["shard"] for r in got if r["doc_id"] % 150 == k}) == 1


def test_groups_of_any_part_of_a_shard_are_whole(make, prose):
    """Copies of 2 to 90 % of a shard, each held by one shard; one of more than a shard says that it is split."""
    for shards in (3, 7, 20):
        part = 100_000 // shards
        shares = [0.02, 0.03, 0.1, 0.25, 0.5, 0.9, 1.7]
        rows, groups = [], {}
        for g, share in enumerate(shares):
            text = f"group {g} " + "x" * 84
            n = max(int(share * part / (len(text) + sh.OVERHEAD)), 2)
            groups[g] = range(1000 * g, 1000 * g + n)
            rows += [(i, text) for i in groups[g]]
        rest = 100_000 - sum(len(t) + sh.OVERHEAD for _, t in rows)
        rows += [(50_000 + i, f"{i} {prose(20, i)}"[:84]) for i in range(rest // 100)]
        got = sh.shard_by_size(make(rows), shards).collect()
        laws(rows, got, shards)
        for g, ids in groups.items():
            mine = [r for r in got if r["doc_id"] in ids]
            assert len(mine) == len(ids)
            if shares[g] < 1:
                assert len({r["shard"] for r in mine}) == 1 and not any(r["group_split"] for r in mine)
            else:
                assert all(r["group_split"] for r in mine)
        assert not any(r["group_split"] for r in got if r["doc_id"] >= 50_000)


def test_more_large_groups_than_room(make):
    """Nine groups of 0.6 of a shard and five shards: five have homes, the others are split; bytes stay near equal."""
    rows = [(100 * g + i, f"group {g}") for g in range(9) for i in range(20)]
    rows += [(10_000 + i, f"few {i:03}") for i in range(-(-9 * 20 * 5 // 9) // 5 * 3)]
    got = sh.shard_by_size(make(rows), 5).collect()
    laws(rows, got, 5)
    whole = [g for g in range(9) if not any(r["group_split"] for r in got if r["doc_id"] // 100 == g)]
    assert len(whole) >= 5
    for g in whole:
        assert len({r["shard"] for r in got if r["doc_id"] // 100 == g}) == 1
