"""Keyed state in buckets: what an upsert reads and writes, and what readers see."""

import random

import pytest

from tapeloom.sources import buckets

SCHEMA = "k string, n long, v string, w string"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def state(spark, root):
    return {r["k"]: tuple(r) for r in buckets.read_state(spark, root).collect()}


def test_upserts_equal_a_plain_table(spark, tmp_path):
    rng, root, plain = random.Random(1), str(tmp_path / "t"), {}
    for turn in range(4):
        rows = [(f"k{rng.randrange(60)}", turn * 100 + i, f"v{turn}-{i}", f"w{turn}-{i}") for i in range(30)]
        update = ["n", "v"] if turn == 2 else None
        buckets.upsert_state(frame(spark, rows), root, ["k"], ["n"], update, buckets=8)
        for k, r in {r[0]: r for r in rows}.items():  # the last row of each key
            plain[k] = (*r[:3], plain[k][3]) if update and k in plain else r
        assert state(spark, root) == plain


def test_first_rows_stay(spark, tmp_path):
    root = str(tmp_path / "t")
    buckets.insert_state(frame(spark, [("a", 2, "x", "x"), ("a", 1, "y", "y"), ("b", 1, "z", "z")]), root, ["k"], ["n"])
    buckets.insert_state(frame(spark, [("a", 0, "later", ""), ("c", 5, "new", "")]), root, ["k"], ["n"])
    assert {k: r[2] for k, r in state(spark, root).items()} == {"a": "y", "b": "z", "c": "new"}


def test_a_delta_of_one_key_touches_one_bucket_and_old_readers_stay_whole(spark, tmp_path):
    root = str(tmp_path / "t")
    buckets.upsert_state(frame(spark, [(f"k{i}", i, "old", "") for i in range(200)]), root, ["k"], ["n"], buckets=16)
    before = buckets.read_state(spark, root)
    one, content = buckets.newest_version(spark, root)
    buckets.upsert_state(frame(spark, [("k7", 1000, "new", "")]), root, ["k"], ["n"])
    two, after = buckets.newest_version(spark, root)
    changed = [b for b in after["folders"] if after["folders"][b] != content["folders"].get(b)]
    assert (one, two) == (1, 2) and len(content["folders"]) == 16 and len(changed) == 1
    assert before.where("v = 'new'").count() == 0 and before.count() == 200
    assert state(spark, root)["k7"][2] == "new" and len(state(spark, root)) == 200
    buckets.expire(spark, root)
    assert len(state(spark, root)) == 200 and buckets.newest_version(spark, root)[0] == 2


def test_of_two_writers_one_succeeds(spark, tmp_path):
    root = str(tmp_path / "t")
    buckets.upsert_state(frame(spark, [("a", 1, "x", "")]), root, ["k"], ["n"])
    number, content = buckets.newest_version(spark, root)
    buckets.add_version(spark, root, number + 1, content)
    with pytest.raises(buckets.VersionConflict):
        buckets.add_version(spark, root, number + 1, content)


def test_no_rows_and_no_table(spark, tmp_path):
    root = str(tmp_path / "t")
    assert buckets.read_state(spark, root) is None
    buckets.upsert_state(frame(spark, []), root, ["k"], ["n"])
    assert buckets.read_state(spark, root) is None
