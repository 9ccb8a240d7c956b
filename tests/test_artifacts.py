from quarrybed.operators import artifacts as A


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_siblings_and_far_names(spark):
    f = spark.createDataFrame([("a", "a.dat"), ("a", "a.idx"), ("b", "b.dat"), ("c", "1"), ("c", "2"), ("c", "3")], "stem string, name string")
    assert rows(A.sibling_pairs(f, "stem", "name"), "a") == [("a", "a.dat", "a.idx"), ("a", "a.idx", "a.dat")]
    c = spark.createDataFrame([(17, 4), (17, 5), (18, 4)], "segment int, offset int")
    u, s = spark.createDataFrame([(1, "Graph")], "segment int, unit string"), spark.createDataFrame([("Graph", 4, "Line")], "unit string, offset int, symbol string")
    assert [r[2] for r in rows(A.far_names(c, u, s, 16), "segment", "offset")] == ["Graph.Line", "Graph+0005", "0012:0004"]


def test_dispatch_and_flow(spark):
    i = spark.createDataFrame([("jmp word [v1]",), ("mov word [v1], 0x10",), ("mov word [v1], 32",), ("mov word [v2], 5",)], "text string")
    assert rows(A.dispatch_targets(i), "target") == [("v1", 16), ("v1", 32)]
    b = spark.createDataFrame([("f", 0), ("f", 4), ("f", 8), ("g", 0)], "function string, start int")
    e = spark.createDataFrame([("f", 0, 4), ("f", 4, 8), ("f", 8, 4), ("f", 0, 8)], "function string, src int, dst int")
    assert rows(A.flow_counters(b, e), "function") == [("f", 3, 4, 1, 0, 0, 3), ("g", 1, 0, 0, 0, 0, 1)]
    ends = spark.createDataFrame([("f", 0, "jump"), ("f", 4, "indirect"), ("f", 8, "return"), ("g", 0, "return")], "function string, start int, ends string")
    assert [tuple(r)[4:6] for r in A.flow_counters(ends, e).orderBy("function").collect()] == [(1, 1), (1, 0)]


def test_multisets_and_conflicts(spark):
    a = spark.createDataFrame([(1, None), (1, None), (2, "x")], "i int, s string")
    assert A.multiset_compare(a, a, ["i", "s"]).count() == 0
    assert rows(A.multiset_compare(a, a.distinct(), ["i", "s"]), "i") == [(1, None, 2, 1)]
    items = spark.createDataFrame([(1, 5), (2, 9), (3, 7), (4, 7)], "k int, s int")
    conflicts = spark.createDataFrame([(1, 2), (1, 3), (3, 2), (3, 4)], "a int, b int")
    assert rows(A.conflict_free(items, conflicts, "k", "s"), "k") == [(2, 9), (4, 7)]
    g = spark.createDataFrame([(0, 400), (500, 510), (800, 1000)], "gap_start int, gap_end int")
    assert tuple(g.agg(A.body_bounds(g, 1000).alias("b")).first().b) == (400, 1000)
