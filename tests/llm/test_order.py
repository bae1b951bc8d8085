from tonearm.llm._order import ranges_of


def _numbered(spark, keys, rows_each):
    df = spark.createDataFrame([(k, "x") for k in keys], "k long, own string")
    cut = ranges_of(df, "k", rows_each)
    return cut, [(r.k, r.b) for r in cut.number(df, "k", "b").collect()]


def test_ranges_are_contiguous_and_none_is_empty(spark):
    keys = [i * i % 1009 for i in range(500)] + [None, None, 5, 5, 5]
    cut, got = _numbered(spark, keys, 50)
    assert len(cut) > 4 and {b for _, b in got} == set(range(len(cut)))
    for b in range(len(cut)):
        own = [k for k, x in got if x == b and k is not None]
        assert min(own) == cut.firsts[b] and (b + 1 == len(cut) or max(own) < cut.firsts[b + 1])
    assert {b for k, b in got if k is None} == {0}


def test_large_keys_one_key_and_none(spark):
    big = [(1 << 60) + i for i in range(100)]
    cut, got = _numbered(spark, big, 10)
    firsts = {}
    for k, b in got:
        firsts[b] = min(firsts.get(b, k), k)
    assert [firsts[b] for b in sorted(firsts)] == cut.firsts
    cut, got = _numbered(spark, [7] * 30, 5)
    assert len(cut) == 1 and {b for _, b in got} == {0}
    cut, got = _numbered(spark, [], 5)
    assert len(cut) == 1 and got == []
    cut, got = _numbered(spark, [None], 5)
    assert len(cut) == 1 and got == [(None, 0)]


def test_keys_that_share_a_double(spark):
    for keys in ([(1 << 60) + i for i in range(100)], [-(1 << 63), (1 << 63) - 1, *((1 << 62) + 2048 * i for i in range(100))], [(1 << 62) + i // 2 for i in range(300)]):
        cut, got = _numbered(spark, keys, 10)
        assert len(cut) > 5 and {b for _, b in got} == set(range(len(cut)))
        order = [b for _, b in sorted(got)]
        assert order == sorted(order) and max(order.count(b) for b in set(order)) <= 40


def test_many_null_keys_are_spread(spark):
    cut, got = _numbered(spark, [None] * 400 + list(range(100)), 50)
    assert cut.nulls == 8 and len(cut) == 8 + len(cut.firsts)
    sizes = {}
    for k, b in got:
        if k is None:
            sizes[b] = sizes.get(b, 0) + 1
        else:
            i = b - cut.nulls
            assert cut.firsts[i] <= k and (i + 1 == len(cut.firsts) or k < cut.firsts[i + 1])
    assert set(sizes) == set(range(8)) and max(sizes.values()) < 120
    cut, got = _numbered(spark, [None] * 100, 10)
    assert len(cut) == 10 and {b for _, b in got} == set(range(10))
