from canopy.operators.skew import MAX_HEAVY, heavy_keys, salted_join


def skewed(spark):
    left = spark.range(300).selectExpr("if(id % 3 = 0, 7, id) AS k", "id AS l")
    right = spark.range(300).selectExpr("if(id % 3 = 1, 7, id) AS k", "id AS r")
    return left, right


def test_heavy_keys_are_found_only_above_the_limit(spark, rows):
    left, _ = skewed(spark)
    assert heavy_keys(left, ["k"]) is None
    assert heavy_keys(left, ["k"], rows=300, heavy_rows=300) is None
    assert rows(heavy_keys(left, ["k"], heavy_rows=50)) == [(7, 3)]


def test_number_of_heavy_keys_is_bounded(spark):
    rows = 10 * MAX_HEAVY + 7
    even = spark.range(rows).selectExpr("id div 10 AS k")  # each key holds 10 rows, the limit
    assert heavy_keys(even, ["k"], heavy_rows=1) is None


def test_salted_join_gives_the_same_rows(spark, rows):
    left, right = skewed(spark)
    hot = spark.createDataFrame([(7, 5)], "k long, _slices int")
    plain = rows(left.join(right, "k"))
    assert len(plain) > 10_000
    assert rows(salted_join(left, right, ["k"], left_heavy=hot)) == plain
    assert rows(salted_join(left, right, ["k"], left_heavy=hot, right_heavy=hot)) == plain
    for how in ("left", "left_semi", "left_anti"):
        assert rows(salted_join(left, right, ["k"], how, left_heavy=hot)) == rows(left.join(right, "k", how))


def test_hot_rows_are_spread_over_tasks(spark):
    """No task of the join sees more than about a slice of the hot key."""
    left = spark.range(60_000).selectExpr("if(id % 3 = 0, 7, id) AS k", "id AS l")
    right = spark.range(60_000).selectExpr("id AS k", "id AS r")
    heavy = heavy_keys(left, ["k"], heavy_rows=1_000)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        joined = salted_join(left, right, ["k"], left_heavy=heavy).where("k = 7")
        sizes = [n for n in joined.rdd.mapPartitions(lambda p: [sum(1 for _ in p)]).collect() if n]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert sum(sizes) == 20_001  # the multiples of three, and key 7 itself
    assert len(sizes) == 4 and max(sizes) < 10_000
