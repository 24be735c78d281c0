"""The three-way fold: its decision table, properties, and the other merges and changes."""

import random

from pyspark.sql import functions as F

from foliospark.operators import changes, merge

ENTRY = "id string, updatedAt string, title string, pos long"


def frame(spark, rows, schema=ENTRY):
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], schema)


def base(spark, rows):
    return spark.createDataFrame(rows, "id string, updatedAt string")


def folded(local, remote, b, **kw):
    return [(r.id, r.action, r.title) for r in merge.fold_entries(local, remote, b, **kw).orderBy("pos").collect()]


def test_decision_table(spark):
    local = frame(spark, [("a", "2", "la"), ("b", "5", "lb"), ("n", "1", "ln"), ("z", None, "lz")])
    remote = frame(spark, [("x", "1", "rx"), ("a", "3", "ra"), ("b", "4", "rb"), ("d", "3", "rd"), ("e", "9", "re"), ("", "9", "r?"), (None, "9", "r?"), ("z", None, "rz")])
    b = base(spark, [("a", "1"), ("b", "1"), ("d", "3"), ("e", "3")])
    assert folded(local, remote, b) == [("a", "updated", "ra"), ("b", "local", "lb"), ("n", "local_only", "ln"), ("z", "local", "lz"), ("x", "kept", "rx"), ("e", "kept", "re")]
    actions = merge.fold_actions(local, remote, b)
    assert tuple(merge.fold_report(actions).first()) == (2, 1, 1)
    assert merge.fold_guard(actions, remote).first().safe is False  # rows without an id count for the guard
    assert merge.fold_guard(actions, remote.where("id <> ''")).first().safe is True
    assert [a for _, a, _ in folded(local, remote, b, replaced=True)] == ["local"] * 4
    assert [a for _, a, _ in folded(local, remote, b, remote_ok=False)] == ["local"] * 4


def test_repeated_local_ids(spark):
    local = frame(spark, [("a", "1", "first"), ("a", "1", "last")])
    assert folded(local, frame(spark, [("a", "2", "new")]), base(spark, [])) == [("a", "local_only", "first"), ("a", "updated", "new")]


def test_fold_properties(spark):
    rng = random.Random(7)
    for _ in range(4):
        ids = [f"i{k}" for k in range(30)]
        pick = lambda p: [(i, str(rng.randrange(9)), f"t{rng.randrange(99)}") for i in ids if rng.random() < p]  # noqa: E731,B023
        local, remote = frame(spark, pick(0.7)), frame(spark, pick(0.7))
        b = base(spark, [(i, s) for i, s, _ in pick(0.5)])
        once = merge.fold_entries(local, remote, b)
        got = {r.id: r.action for r in once.collect()}
        known = {r.id for r in b.collect()}
        here, there = {r.id for r in local.collect()}, {r.id for r in remote.collect()}
        assert here <= set(got) and (there - here) - set(got) <= known  # only what the base knew may go
        again = merge.fold_entries(once.drop("action"), remote, b)
        assert sorted((r.id, r.title) for r in again.collect()) == sorted((r.id, r.title) for r in once.collect())


def test_collections_blocks_and_replace(spark):
    schema = "id string, name string, pos long"
    local, remote = frame(spark, [("a", "A")], schema), frame(spark, [("a", "B"), ("b", "B"), ("c", "C")], schema)
    assert [(r.id, r.name) for r in merge.fold_collections(local, remote, base(spark, [("c", "")])).orderBy("pos").collect()] == [("a", "A"), ("b", "B")]
    rows = spark.createDataFrame([("x", "y", "x", "d"), ("x", "y", None, "d"), ("d", "y", None, "d"), ("x", None, "x", "d"), ("x", "x", "x", "d")], "l string, r string, b string, d string")
    got = [r[0] for r in rows.select(merge.fold_block(*map(F.col, "lrbd"))).collect()]
    assert got == ["y", "x", "y", "x", "x"]
    own = spark.sql("SELECT named_struct('passHash', 'h') admin, named_struct('owner', 'me') publish, 1 version")
    other = spark.sql("SELECT named_struct('passHash', '') admin, named_struct('owner', 'you') publish, 1 version")
    r = merge.import_replace(own, other).first()
    assert (r.admin.passHash, r.publish.owner, r.replaced) == ("h", "you", True)
    filled = spark.sql("SELECT named_struct('owner', '', 'repo', 'r', 'branch', cast(null as string), 'path', 'p') l, named_struct('owner', 'o', 'repo', 'x', 'branch', 'b', 'path', 'y') r").select(merge.fold_publish(F.col("l"), F.col("r"))).first()[0]
    assert tuple(filled) == ("o", "r", "b", "p")


def test_imports_and_sets(spark):
    schema = "id string, title string, pos long"
    got = merge.import_merge(frame(spark, [("a", "A")], schema), frame(spark, [("a", "A2"), ("b", "B"), ("", "C")], schema)).orderBy("pos").collect()
    assert [r.title for r in got] == ["A", "A2", "B", "C"] and len({r.id for r in got}) == 4 and got[2].id == "b"
    one = spark.createDataFrame([(["a", "b", "a"],), ([],), (None,)], "x array<string>")
    assert [r[0] for r in one.select(merge.set_add(F.col("x"), F.lit("c"))).collect()] == [["a", "b", "a", "c"], ["c"], ["c"]]
    assert [r[0] for r in one.select(merge.set_remove(F.col("x"), F.lit("a"))).collect()] == [["b", "a"], [], None]
    assert spark.createDataFrame([(" a, b,,a ",)], "x string").select(merge.split_tags(F.col("x"))).first()[0] == ["a", "b"]
    a = spark.createDataFrame([(1, None)], "p int, q string")
    assert merge.content_diff(a, a).collect() == [] and merge.content_diff(a, a.where("false")).first().n == 1


def test_changes(spark):
    rows = spark.createDataFrame([("a", 0.0, 0), ("b", 0.0, 1), ("c", 5.0, 2)], "id string, order double, pos long")
    order = lambda df: [r.id for r in df.orderBy("order").collect()]
    assert order(changes.move(rows, "b", -1)) == ["b", "a", "c"] and order(changes.move(rows, "c", 1)) == ["a", "b", "c"] and order(changes.move(rows, "zz", 1)) == ["a", "b", "c"]
    style = spark.sql("SELECT named_struct('gradStops', array(named_struct('c', 'x', 'p', 1D)), 'gradFrom', '', 'gradTo', '', 'font', 'f') s")
    look = {"gradStops": F.expr("array(named_struct('c', '#2', 'p', 90D), named_struct('c', '#1', 'p', 5D))")}
    got = style.select(changes.apply_look(F.col("s"), look)).first()[0]
    assert (got.gradFrom, got.gradTo, got.font) == ("#1", "#2", "f")
    states = spark.createDataFrame([(True, False, True), (False, False, False)], "d boolean, b boolean, p boolean").select(changes.draft_state(*map(F.col, "dbp"))).collect()
    assert [tuple(r[0]) for r in states] == [(True, True, True), (False, False, False)]
