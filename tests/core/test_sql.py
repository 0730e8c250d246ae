import pytest

from kolumna.errors import ParseError
from kolumna.sql import ast, parse
from kolumna.sql.ast import Binary, Literal, Name


def where(sql):
    return parse(f"SELECT a FROM t WHERE {sql}").where


def test_precedence_of_comparison_over_sum_and_logic():
    assert where("a > b + 1 AND c = 2 OR d < 3") == Binary(
        "OR", Binary("AND", Binary(">", Name("a"), Binary("+", Name("b"), Literal(1))), Binary("=", Name("c"), Literal(2))), Binary("<", Name("d"), Literal(3))
    )


def test_sums_associate_to_the_left():
    assert where("a - b - 1") == Binary("-", Binary("-", Name("a"), Name("b")), Literal(1))


def test_keywords_in_any_case_and_both_spellings_of_unequal():
    assert parse("select a from t where a <> 1") == parse("SELECT a FROM t WHERE a != 1;")


def test_comments_strings_and_negative_numbers():
    assert parse("SELECT a -- one\n/* two */ FROM t WHERE b = 'it''s' AND c > -2.5").where == Binary("AND", Binary("=", Name("b"), Literal("it's")), Binary(">", Name("c"), Literal(-2.5)))


def test_names_of_outputs():
    s = parse("SELECT a + 1, COUNT(*), SUM(a) total, 1.5 FROM t")
    assert [i.name for i in s.items] == ["(a + 1)", "COUNT(*)", "total", "1.500000"]


def test_create_and_insert():
    c = parse("CREATE TABLE u (id INT PRIMARY KEY, age integer, KEY idx(age), KEY(id, age))")
    assert [k.name for k in c.keys] == ["idx", None] and c.columns[0].primary
    i = parse("INSERT INTO u (id, age) VALUES (1, 2), (1 + 2, 3)")
    assert isinstance(i, ast.Insert) and len(i.rows) == 2


@pytest.mark.parametrize(
    "sql",
    [
        "", "SELECT", "SELECT a", "SELECT a FROM t extra junk", "SELECT a / b FROM t", "SELECT a FROM t ORDER BY a", "SELECT a FROM t WHERE a ! 1", "SELECT a FROM t WHERE b = 'open", "SELECT UPPER(a) FROM t",
        "SELECT a FROM t, u", "SELECT a FROM t LIMIT 1", "INSERT INTO t VALUES (1) x", "CREATE TABLE t (a INT) x", "UPDATE t", "SET MODE fast", "SELECT a FROM t WHERE a < b < c", "SELECT 99999999999999999999 FROM t", "SELECT a FROM t /* open",
    ],
)
def test_rejected(sql):
    with pytest.raises(ParseError):
        parse(sql)
