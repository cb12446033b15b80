import pytest

from gradeline.sources.store import Conflict, ContentStore, Versions


def test_versions(spark, tmp_path):
    v = Versions(spark, str(tmp_path / "state"))
    assert v.current() == {}
    for n in (1, 2):
        v.propose({"n": n})
        assert v.promote() == n
    v.propose({"n": 9})
    assert v.rollback(1) == 3 and v.current() == {"n": 1} and v.numbers() == [3, 2, 1]
    v.propose({"n": 5})
    v.discard()
    assert v.current() == {"n": 1} and not [f for f in (tmp_path / "state").iterdir() if "candidate" in f.name]


def test_of_two_writers_one_wins_on_a_mounted_file_system(spark, tmp_path):
    (tmp_path / "m").mkdir()
    spark._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.versions.link./at", f"file://{tmp_path}/m")
    one, two = (Versions(spark, "viewfs://versions/at/state") for _ in range(2))
    one.propose({"by": "one"})
    two.propose({"by": "two"})
    assert two.promote() == 1
    with pytest.raises(Conflict):
        one.promote()
    assert one.current() == {"by": "two"}
    one.propose({"by": "one", "after": one.current()})
    assert one.promote() == 2 and two.current()["after"] == {"by": "two"}


def frame(spark, *contents):
    return spark.createDataFrame([(c,) for c in contents], "content binary")


def test_contents_are_held_once(spark, tmp_path):
    store = ContentStore(spark, str(tmp_path / "s"))
    assert store.put(frame(spark, b"a", b"a", b"b", None, b"")) == 3
    assert store.put(frame(spark, b"a", b"b")) == 0 and store.put(frame(spark, b"c", b"a")) == 1
    assert sorted(bytes(r["content"]) for r in store.contents().collect()) == [b"", b"a", b"b", b"c"]
    assert store.contents().where("sha2(content, 256) <> sha256 or octet_length(content) <> size").count() == 0


def test_a_writer_that_comes_second_drops_what_the_first_has(spark, tmp_path):
    first, second = (ContentStore(spark, str(tmp_path / "s")) for _ in range(2))
    put = second.log.put
    once = []

    def late(number, entry):
        if not once:  # the other one commits between this one's write and its commit
            once.append(first.put(frame(spark, b"x", b"y")))
        put(number, entry)

    second.log.put = late
    assert second.put(frame(spark, b"y", b"z")) == 1 and once == [2]
    assert sorted(bytes(r["content"]) for r in second.contents().collect()) == [b"x", b"y", b"z"]
    assert first.log.numbers() == [2, 1]
