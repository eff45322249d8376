import random
import unicodedata
from types import SimpleNamespace

import pytest
from py4j.java_gateway import JavaClass

from seamline.llm import lookalikes
from seamline.llm.lookalikes import lookalike_pairs, mapping, visual_classes, visual_forms

SCHEMA = "doc_id bigint, text string, form string, run string"


def forms(spark, *texts):
    df = spark.createDataFrame([(k, t, "f", "r") for k, t in enumerate(texts)], SCHEMA)
    return [r.form for r in visual_forms(df).orderBy("id").collect()]


def test_forms(spark):
    got = forms(spark, None, "", "plain", "ｆｕｌｌ　ｗｉｄｔｈ！", "café", "café", "a​b­c﻿", "x y z", "раураl", "ﬁne ﬀ", "𝚟𝚎𝚌", "ạ̇ ạ̇", "び", "e​́", "l\r\nm\rn", "co‐op", "κ́", "가", "가")
    assert got == [None, "", "plain", "full width!", "café", "café", "abc", "x y z", "paypal", "fine ff", "vec", "ạ̇ ạ̇", "び", "é", "l\nm\nn", "co-op", unicodedata.normalize("NFC", "ḱ"), "가", "가"]


def test_what_stays_apart(spark):
    family = "👩‍💻"
    got = forms(spark, family, "👩💻", "Case", "case", "cafe", "café", "x²", "x2", "می‌خواهم", "میخواهم", "a  b", "a b", "❤️", "½", "1/2")
    assert got[0] == family and len(set(got)) == len(got)


def test_random_texts_against_plain_normalisation(spark):
    rng = random.Random(4)
    table = {c: "".join(chr(x) for x, _ in p) for c, p in mapping(spark)}
    pool = [*range(0x20, 0x7F), *range(0xC0, 0x180), *range(0x300, 0x330), *range(0x3B1, 0x3C9), *range(0x430, 0x450), *range(0xFF01, 0xFF5E), 0x200B, 0xA0, 0x3042, 0x4E2D, 0x1F600]
    texts = ["".join(chr(rng.choice(pool)) for _ in range(rng.randrange(40))) for _ in range(300)]
    want = [unicodedata.normalize("NFC", "".join(ch if "\x1f" < ch < "\x7f" else table.get(ord(ch), ch) for ch in t)) for t in texts]
    assert forms(spark, *texts) == want


def test_pairs(spark):
    rows = [(1, "café"), (2, "café"), (3, "café"), (4, "cafe"), (5, "​ "), (6, " "), (7, None), (8, ""), (9, "ｃafé"), (9, "ｃafé"), *[(100 + i, "same") for i in range(50)], (200, "а" * 100_000), (201, "a" * 100_000)]
    df = spark.createDataFrame([(i, t, "f", "r") for i, t in rows], SCHEMA)
    classes = visual_classes(df)
    assert {tuple(r) for r in lookalike_pairs(classes).collect()} == {(1, 2), (1, 3), (1, 9), (2, 9), (3, 9), (200, 201)}
    assert classes.count() == len(rows) - 1 and classes.filter("id > 99 AND id < 150").select("form_key").distinct().count() == 1
    assert lookalike_pairs(visual_classes(df.limit(0))).count() == 0


def test_forms_of_other_scripts(spark):
    same = [("ﻣ", "م"), ("Ꭺ", "A"), ("ⲟ", "o"), ("ꓐ", "B"), ("﹢", "+"), ("ﺍﻟﺴﻼﻡ", "السلام"), ("e\u0316\u0301", "é\u0316"), ("\u09c7\u09be", "\u09cb"), ("\u0dd9\u0dcf\u0dca", "\u0ddd"), ("각", "\u1100\u1161\u11a8"), ("가\u11a8", "각")]
    got = forms(spark, *[x for p in same for x in p])
    assert got[::2] == got[1::2]
    apart = ["ı", "i", "σ", "o", "l", "1", "I", "0", "O", "m", "rn", "é", "e", "ſ", "f", "г", "r", "ø", "中", "口"]
    assert len(set(forms(spark, *apart))) == len(apart)


def test_long_runs_are_cut_without_a_trace(spark):
    rng = random.Random(6)
    pool = [*range(0xE01, 0xE2F), 0xE34, 0xE48, 0x301, 0x302, 0x323, 0x3042, 0x304B, 0x3099, 0x430, 0x438, 0x306, 0x1100, 0x1161, 0x11A8, 0x915, 0x93C, 0x200D, 0x1F468, 0x4E2D]
    texts = ["".join(chr(rng.choice(pool)) for _ in range(n)) for n in (1, 47, 48, 49, 50, 300, 1000) for _ in range(6)] + ["中" * 20_000 + "は\u3099", "ก" * 20_000]
    table = {c: "".join(chr(x) for x, _ in p) for c, p in mapping(spark) if c != 0x200D}
    want = [unicodedata.normalize("NFC", "".join(table.get(ord(ch), ch) for ch in t)) for t in texts]
    got = forms(spark, *texts)
    no_joiner = lambda x: x.replace("\u200d", "")
    assert [no_joiner(unicodedata.normalize("NFC", no_joiner(g))) for g in got] == [unicodedata.normalize("NFC", no_joiner(w)) for w in want]


class Jvm:
    """The JVM of a session, but for the Unicode library."""

    def __init__(self, jvm, library):
        self.jvm, self.library = jvm, library

    def __getattr__(self, name):
        return self.library(name) if name.startswith("com.ibm.icu.") else getattr(self.jvm, name)


class Short(JavaClass):
    """A library whose answer lacks the last letter."""

    def __init__(self):
        pass

    def __call__(self):
        return SimpleNamespace(build=lambda: SimpleNamespace(getSkeleton=lambda kind, text: text.rpartition("\n")[0]))


def test_without_the_public_data_there_is_no_result(spark, monkeypatch):
    df = spark.createDataFrame([(1, "Ꭺpple"), (2, "Apple")], "doc_id bigint, text string")
    pairs = lambda: [tuple(r) for r in lookalike_pairs(visual_classes(df)).collect()]
    jvm = spark._jvm

    def broken(name):
        raise ConnectionError("broken")

    libraries = [(lambda name: getattr(jvm, "missing." + name), RuntimeError, "icu4j"), (lambda name: Short(), RuntimeError, "skeletons for"), (broken, ConnectionError, "broken")]
    lookalikes._skeletons.cache_clear()
    for library, error, message in libraries:
        with monkeypatch.context() as m:
            m.setattr(spark, "_jvm", Jvm(jvm, library))
            with pytest.raises(error, match=message):
                pairs()
    assert pairs() == [(1, 2)]  # a failure is not remembered
