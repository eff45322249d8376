import pytest

from seamline.functions.regex import RegexError, SearchOption, quote_meta, required_literal, route, to_java
from seamline.operators.lines import grep

#: Pattern, text and the numbers of the lines that match.
CASES = [
    ("a+", "abc\ndef\nghi\n", [1]), ("^abcdefg", "abcdefg", [1]), ("a+", "baaab", [1]), ("abcd..", "abcdef", [1]), ("x", "y", []), (".*", "abcdef", [1]), ("^", "abcde", [1]), ("$", "abcde", [1]), ("^abcd$", "abcde", []),
    ("[^a-z]+", "ab1234cd", [1]), (r"[a\-\]z]+", "az]-bcz", [1]), (r"[^\n]+", "abcd\n", [1]), ("[日本語]+", "日本語日本語", [1]), ("日本語+", "日本語語", [1]), ("(.)(.)", "日a", [1]), ("(([^xyz]*)(d))", "abcd", [1]),
    (r"\a\f\r\t\v", "\a\f\r\t\v", [1]), (r"[\a\f\n\r\t\v]+", "\a\f\r\t\v", [1]), ("a*(|(b))c*", "aacc", [1]), ("[.]", ".", [1]), ("/$", "/abc/", [1]), ("/$", "/abc", []), ("axxb$", "axxcb", []), ("da(.)a$", "daXY data", [1]),
    ("(aa)*$", "a", [1]), ("(?:A(?:A|a))", "Aa", [1]), (r"\b", "x y", [1]), (r"\B", "x", []), (r"\B", "xx", [1]), (r"\B", "x y", []), ("(?im)^[abc]+$", "abcABC", [1]), ("(?im)^[α]+$", "αΑ", [1]), ("[Aa]BC", "abc", []),
    (r"[^\S\s]", "abcd", []), (r"[^\S[:space:]]", "abcd", []), (r"[^\D\d]", "abcd", []), (r"[^\D[:digit:]]", "abcd", []), (r"(?i)\W", "k", []), (r"(?i)\W", "s", []),
    (r"\!\"\#\$\%\&\'\(\)\*\+\,\-\.\/\:\;\<\=\>\?\@\[\\\]\^\_\{\|\}\~", "!\"#$%&'()*+,-./:;<=>?@[\\]^_{|}~", [1]), (r"[\!\"\#\$\%\&\'\(\)\*\+\,\-\.\/\:\;\<\=\>\?\@\[\\\]\^\_\{\|\}\~]+", "!\"#$%&'()*+,-./:;<=>?@[\\]^_{|}~", [1]),
    ("a+", "abc\ndef\nghalloo\n", [1, 3]), ("x.*y", "xay\nxa\ny\n", [1]), ("b$", "ab\r\nb c\r\n", [1]), ("a.b", "a\rb", [1]), (r"x\b", "xéy", [1]), (r"\bé", "xé", [1]), ("[[:digit:]]", "5", [1]), ("[[:digit:]]", ":", []),
    ("[[a]b", "[b", [1]), ("[a&&b]", "&", [1]), ("(?P<n>a)(?<m>b)", "ab", [1]), (r"(?U)a+\w", "aé", []), ("a{2}", "aa", [1]), ("a{,2}", "a{,2}", [1]), ("x{", "x{", [1]), (r"\x41\x{42}", "AB", [1]), (r"\Qa.b\E", "axb", []), (r"\Qa.b\E.", "a.bc", [1]),
    (r"\pL\p{Greek}", "aα", [1]), (r"[^\pL]", "a", []), (r"\P{^Lu}", "A", [1]), (r"\v", "\n\n", []), (r"\s", "\x0b", []), ("[]a]", "]", [1]), ("[[:^alpha:]]", "a", []), ("^$", "a\n\nb", [2]), ("", "a\n\n", [1, 2]),
]


def test_lines_that_match(spark):
    for k in range(0, len(CASES), 20):
        part = CASES[k : k + 20]
        made = None
        for n, (pattern, text, _) in enumerate(part):
            df = grep(spark.createDataFrame([(n, text)], "doc_id int, text string"), ["doc_id"], SearchOption(pattern, True)).select("doc_id", "line_no")
            made = df if made is None else made.unionByName(df)
        got = sorted(tuple(r) for r in made.collect())
        assert got == sorted((n, i) for n, (_, _, found) in enumerate(part) for i in found)


@pytest.mark.parametrize("bad", ["(?=a)", "(?!a)", "(?<=a)b", "(?>a)", r"(a)\1", "a++", "a**", "*a", "(", ")", "[a", r"\Z", r"\y", "a{1001}", "(?x)a", "[[:nope:]]", "a\\", r"\x4", r"\k<n>"])
def test_refused(bad):
    with pytest.raises(RegexError):
        to_java(bad)


def test_routing():
    assert route("  ") is None
    assert route("plain.name") == SearchOption("plain.name", False, (".go", ".py", ".tf", ".yml", ".yaml"))
    assert route("a|b").regex and route("foo(").text == "foo(" and not route("foo(").regex
    assert route("two w.rds").text == r"two|w\.rds" and route("two w.rds").regex
    assert quote_meta("a.b|c") == r"a\.b\|c"


def test_required_literals():
    want = {"func \\w+": "func ", "abc*d": "ab", "abc{0,2}": "ab", r"a\.b+": "a.b", "a|b": "", "(?i)abc": "", "^abc": "", "ab(c)?": "ab", r"\bab": "", "ab+": "ab", "x.y": "x", "(?:a|b)": "", "": ""}
    assert {p: required_literal(p) for p in want} == want
