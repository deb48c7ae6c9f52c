from pyspark.sql import functions as F

from conftest import one_col
from transloom.functions import text as T


def col_values(df, c):
    return [r[0] for r in df.select(c).collect()]


def test_go_trim_unicode_white_space(spark):
    vals = ["　 a b  \n", "\t\x0b\f\r x", " y ", "  ", "", "​z"]
    df = one_col(spark, vals).select(T.go_trim("x").alias("t"))
    assert col_values(df, "t") == ["a b", "x", "y", "", "", "​z"]  # U+200B is not White_Space


def test_char_count_code_points(spark):
    df = one_col(spark, [" a\U0001F600b "]).select(T.char_count("x").alias("n"))
    assert col_values(df, "n") == [3]


def test_shorten_and_tail(spark):
    df = one_col(spark, ["abcdef", "abc", "  xyz  "]).select(T.shorten("x", 3).alias("s"), T.tail("x", 2).alias("t"))
    rows = [tuple(r) for r in df.collect()]
    assert rows == [("abc…", "…ef"), ("abc", "…bc"), ("  x…", "…yz")]


def test_byte_cut_replaces_split_code_point(spark):
    df = one_col(spark, ["a" * 499 + "中", "short"]).select(T.byte_cut("x", 500).alias("c"))
    assert col_values(df, "c") == ["a" * 499 + "�", "short"]


def test_safe_name_reference_case(spark):
    df = one_col(spark, ["facebook/nllb-200:demo", "a\\b"]).select(T.safe_name("x").alias("s"))
    assert col_values(df, "s") == ["facebook--nllb-200-demo", "a--b"]


def test_html_escape_ampersand_first(spark):
    df = one_col(spark, ['<a href="x">&amp;</a>']).select(T.html_escape("x").alias("e"))
    assert col_values(df, "e") == ["&lt;a href=&quot;x&quot;&gt;&amp;amp;&lt;/a&gt;"]


def test_endpoint_cases(spark):
    cases = {
        "https://api.example.com": "https://api.example.com/v1/chat/completions",
        "https://api.example.com/v1/": "https://api.example.com/v1/chat/completions",
        "https://x.net/V1": "https://x.net/V1/chat/completions",
        "https://x.net/openai/Chat/Completions//": "https://x.net/openai/Chat/Completions",
        "http://h/api": "http://h/api/v1/chat/completions",
    }
    df = one_col(spark, list(cases)).select("x", T.endpoint("x").alias("e"))
    assert {r.x: r.e for r in df.collect()} == cases


def test_error_text(spark):
    df = one_col(spark, ["Error: boom", "error:   x", "plain", None]).select(T.error_text("x").alias("e"))
    assert col_values(df, "e") == ["boom", "x", "plain", "发生未知错误"]


def test_paragraph_parts_round_trip(spark):
    text = "a\n\nb\r c\n"
    df = one_col(spark, [text]).select(T.paragraph_parts("x").alias("p"))
    parts = df.collect()[0].p
    assert parts == ["a", "\n\n", "b\r c", "\n"]
    assert "".join(parts) == text


def test_named_columns_are_trimmed_alike(spark):
    """A column by its name, which is looked at by its edges first, and the same as an expression."""
    edges = ["", " ", "\t", " ", " ", "　", "\x85", "​", "x", "\U0001f600", "\n"]
    values = [a + m + b for a in edges for m in ("", "y  z", " ") for b in edges] + [None]
    df = one_col(spark, values)
    got = df.select(T.go_trim("x").alias("a"), T.go_trim(F.concat("x", F.lit(""))).alias("b"), "x").collect()
    assert all(r.a == r.b == (None if r.x is None else r.x.strip(T.GO_SPACE)) for r in got)
