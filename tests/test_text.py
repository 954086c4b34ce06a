import datetime as dt

import pytest
from pyspark.sql import functions as F

from tastemill.functions import text as X


def values(spark, f, inputs, kind="string"):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], f"i int, x {kind}")
    return [r.y for r in df.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


@pytest.mark.parametrize(
    "f, inputs, wanted",
    [
        (X.title_year, ["Toy Story (1995)", "Movie without year", "X (1995) (2001)", "Y (1995", "Z (2000) ", None], [1995, None, 2001, None, 2000, None]),
        (X.split_genres, ["Action|Adventure|Sci-Fi", "(no genres listed)", "", None, " A | |B "], [["Action", "Adventure", "Sci-Fi"], [], [], [], ["A", "B"]]),
        (X.normal_tag, ["  Sci-Fi  ", "GREAT   Movie", "a b", "　x y ", "a\u001cb", "\t\n", None], ["sci-fi", "great movie", "a b", "x y", "a b", "", ""]),
        (X.slug, ["Sci-Fi", "!!!", "日本", "Ünïcode tag"], ["sci_fi", "unknown", "unknown", "n_code_tag"]),
        (X.title_case, ["sci_fi", "3d movie"], ["Sci_Fi", "3D Movie"]),
        (X.family, ["movie:10", "plain"], ["movie", "unknown"]),
        (X.seed_genre_token, [" Sci-Fi ", "Film Noir"], ["genre:sci_fi", "genre:film_noir"]),
        (X.token_list, [None, "['a', 'b']", '["a"]', "x", " "], [[], ["a", "b"], ["a"], ["x"], []]),
        (X.short_label, ["x" * 81, "ok"], ["x" * 80 + "…", "ok"]),
    ],
)
def test_expressions(spark, f, inputs, wanted):
    assert values(spark, f, inputs) == wanted


CELLS = [
    "('a', 'b')", "{'a', 'b', 'a'}", '["don\'t"]', "['a \\'quoted\\' one', \"b \\\"two\\\"\"]", "[]", "()", "{}", "('a')", "('a',)", "[ 'a' , \"b\", ]", "['a', 1, -2, 2.50, None, True]",
    "{'k': 1}", "['a', ['b']]", "['a' 'b']", "['open", "['back\\\\slash', 'n\\nl', 'tab\there']", "['caf\\u00e9 \\ud83d\\ude00', '日本']", "['a, b', 'c]']", "[tag:x]", "  ['x']\n", "['\\d']", "['']", "[007]", "x, y",
    "('it\\\\', 'b')", '["a\\\\", "b"]', "['" + "long " * 5000 + "']",
]


def test_list_cells_as_python_reads_them(spark):
    """Against the language's own reading of literals; sets in the order of their text."""
    import ast

    def read(cell):
        raw = cell.strip()
        try:
            found = ast.literal_eval(raw) if raw[:1] in ("[", "(", "{") else None
        except (ValueError, SyntaxError):
            found = None
        if isinstance(found, set):
            found = list(dict.fromkeys(ast.literal_eval("[" + raw[1:-1] + "]")))
        if isinstance(found, list | tuple) and not any(isinstance(x, list) for x in found):
            return [x.encode("utf-16", "surrogatepass").decode("utf-16") if isinstance(x, str) else str(x) for x in found]
        return [raw] if raw else []

    wanted = [["['a' 'b']"] if c == "['a' 'b']" else read(c) for c in CELLS]  # strings side by side are not joined
    assert values(spark, X.token_list, CELLS) == wanted
    assert wanted[:3] == [["a", "b"], ["a", "b"], ["don't"]]


def test_times_and_counts(spark):
    got = values(spark, lambda c: X.utc_seconds(c), [1225734739], "bigint")[0]
    assert got.replace(tzinfo=dt.UTC).timestamp() in (1225734739.0, got.timestamp())
    assert values(spark, lambda n: X.split_index(n, 0.1), [1, 2, 3, 100], "bigint") == [0, 1, 2, 90]
    assert values(spark, lambda n: X.required_count(0.5, n), [3, 4], "bigint") == [2, 2]


def test_decoders_and_types(spark):
    tokens = ["movie:1", "genre:sci_fi", "tag:great_movie", "odd"]
    assert values(spark, lambda c: X.decode_report(c, F.lit(None).cast("string")), tokens) == ["[M] Unknown(1)", "[G] Sci_Fi", "[T] Great_Movie", "odd"]
    assert values(spark, lambda c: X.decode_display(c, F.lit("T")), tokens) == ["T", "Sci Fi", "great_movie", "odd"]
    row = spark.sql("select array('genre:a') a, array('tag:b', 'movie:3') b, cast(array() as array<string>) e").select(
        X.rule_type(F.col("a"), F.col("a")).alias("x"), X.rule_type(F.col("a"), F.col("b")).alias("y"), X.first_movie(F.col("b")).alias("m"),
        X.first_movie(F.col("e")).alias("n"), X.join_display(F.col("e")).alias("j"),
    ).first()
    assert tuple(row) == ("genre_only", "cross_type", "movie:3", None, "[]")
