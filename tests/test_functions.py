"""Tokens, text functions and ordered operators on small cases."""

from pyspark.sql import functions as F

from cartolyte.functions import strings, tokens
from cartolyte.operators import lookup, precedence, runs, spatial

#: Tokens computed from the formula (fixed values).
GOLDEN = {
    "gas_ico": 76345156943,
    "hotel_ico": 110242392268968,
    "hud_parking": 110779883858044828,
    "port_overlay": 8422840395203288896,
    "recruitment_ico": 2168726738078482010,
    "garage_large_ico": 5004206289247063131,
    "weigh_station_ico": 15352226154119370655 - (1 << 64),
    "MIDDLE EAST": 193187165558721329,
    "": 0,
}


def test_golden_tokens(spark):
    rows = spark.createDataFrame([(k,) for k in GOLDEN], "name string").select("name", tokens.token(F.col("name")).alias("t"))
    assert {r["name"]: r["t"] for r in rows.collect()} == GOLDEN


def test_tokens_round_trip(spark):
    names = ["a", "z_9", "gas_ico", "port_overlay", "0", "abcdefghijkl"]
    back = spark.createDataFrame([(n,) for n in names], "name string").select("name", tokens.name_of(tokens.token(F.col("name"))).alias("back"))
    assert all(r["name"] == r["back"] for r in back.collect())


def test_line_parsing(spark):
    cases = {
        '\tcity_name: "Alpha" // note': ("city_name", '"Alpha"'),
        "# comment: no": (None, None),
        "// comment: no": (None, None),
        "no colon": (None, None),
        "a: b: c": ("a", "b"),
        "key: x // y // z": ("key", "x // y"),
        " k: v ": ("k", "v"),
    }
    got = spark.createDataFrame([(k,) for k in cases], "line string").select("line", strings.line_key(F.col("line")).alias("k"), strings.line_value(F.col("line")).alias("v"))
    assert {r["line"]: (r["k"], r["v"]) for r in got.collect()} == cases


def test_value_parts(spark):
    row = spark.range(1).select(
        strings.quoted(F.lit('x "Alpha" y')).alias("q"),
        strings.quoted(F.lit("none")).alias("n"),
        strings.dotted_part(F.lit("country.data.beta"), 2).alias("d"),
        strings.vector_part(F.lit("(1.5, 2, -3)"), 2).alias("v"),
        strings.combine_path(F.lit("def"), F.lit("city\\a.sui")).alias("p"),
        strings.combine_path(F.lit("def"), F.lit("/abs/a")).alias("abs"),
        strings.rgb_hex(F.lit(255), F.lit(0), F.lit(10)).alias("c"),
    ).first()
    assert tuple(row) == ("Alpha", None, "beta", -3.0, "def/city/a.sui", "abs/a", "#FF000A")


def test_precedence_does_not_depend_on_row_order(spark):
    rows = [("a", 1, "x"), ("a", 3, "z"), ("a", 2, "y"), ("b", 1, None)]
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, "k string, seq int, v string")
        assert {r["k"]: r["v"] for r in precedence.last_wins(df, ["k"], "seq").collect()} == {"a": "z", "b": None}
        assert {r["k"]: r["v"] for r in precedence.first_wins(df, ["k"], "seq").collect()} == {"a": "x", "b": None}


def test_runs_filter_after_dedupe(spark):
    df = spark.createDataFrame([(1, 1, "p"), (2, 1, "h"), (3, 2, "h"), (4, 2, "h")], "i int, id int, action string").withColumn("g", F.lit(0))
    kept = runs.run_starts(df, ["g"], ["i"], "id").where("action = 'h'")
    assert [r["i"] for r in kept.collect()] == [3]


def test_grid_join_equals_nested_join(spark):
    points = spark.range(200).select(F.col("id").alias("p"), (F.col("id") * 37 % 100).cast("double").alias("x"), (F.col("id") * 53 % 90).cast("double").alias("z"))
    rects = spark.range(12).select(F.col("id").alias("r"), F.col("id").alias("seq"), (F.col("id") * 7 % 80).cast("double").alias("rx"), (F.col("id") * 11 % 70).cast("double").alias("rz"), F.lit(20.0).alias("w"), F.lit(15.0).alias("h"))
    a = {r["p"]: r["r"] for r in spatial.grid_join(points, rects, "p", "r", "seq", 18.0).collect()}
    b = {r["p"]: r["r"] for r in spatial.nested_join(points, rects, "p", "r", "seq").collect()}
    assert a == b and None in a.values()


def test_self_loop_has_no_end(spark):
    c = spark.createDataFrame([(1, 1), (1, 2)], "start_token int, end_token int")
    ports = spark.createDataFrame([(1, 5.0, 6.0, 1), (1, 7.0, 8.0, 2), (2, 1.0, 1.0, 3)], "port_token int, x double, z double, load_seq int")
    got = {(r["start_token"], r["end_token"]): (r["start_x"], r["end_x"]) for r in lookup.port_ends(c, ports).collect()}
    assert got == {(1, 1): (7.0, None), (1, 2): (7.0, 1.0)}


def test_tokens_of_long_names(spark):
    names = ["a", "hud_parking", "z" * 13, "Ab_9" * 12, "Ab_9" * 12 + "x", "road_" * 40, None]
    digits = "0123456789abcdefghijklmnopqrstuvwxyz_"
    unsigned = lambda n: sum((digits.find(c) + 1) * 38**i for i, c in enumerate(n.lower())) % (1 << 64)
    signed = {n: None if n is None else (t := unsigned(n)) - (t >> 63 << 64) for n in names}
    got = spark.createDataFrame([(n,) for n in names], "name string").select("name", tokens.token(F.col("name")).alias("t")).collect()
    assert {r["name"]: r["t"] for r in got} == signed
