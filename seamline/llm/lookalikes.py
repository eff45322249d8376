"""One form for texts that look the same but consist of different characters.

Only the places of the distinct texts that may differ from their plain form are looked at: runs of characters other than
printable ASCII, tab and line ends, with the ASCII character before them, cut at starters. The distinct runs of the corpus are
exploded to positioned code points, joined with the decomposition and look-alike mappings (bounded by Unicode's size, hence broadcast),
their combining marks ordered by class, recomposed by a join with the table of compositions, and rebuilt; runs that come out
changed are put back into their texts.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

from py4j.java_gateway import JavaClass
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from seamline.session import Stage

#: Letters drawn alike, as "letter likeness" pairs; case is kept.
ALIKE = """
а a  е e  о o  р p  с c  у y  х x  ѕ s  і i  ј j  һ h  ԁ d  ԛ q  ԝ w  ѵ v  ӏ l
А A  В B  Е E  К K  М M  Н H  О O  Р P  С C  Т T  У Y  Х X  Ѕ S  І I  Ј J  Ӏ I  Ԛ Q  Ԝ W  Ѵ V
ο o  ν v  α a  ι i  κ k  υ u  ρ p  χ x  γ y  ϲ c  ϳ j
Α A  Β B  Ε E  Ζ Z  Η H  Ι I  Κ K  Μ M  Ν N  Ο O  Ρ P  Τ T  Υ Y  Χ X  Ϲ C  Ϳ J
օ o  ս u  ո n  հ h  ց g  ɑ a  ɡ g  ᴏ o  ᴜ u  ᴠ v  ᴡ w  ᴢ z  ꜱ s
‐ -  ﹣ -  ˗ -  ․ .  ꞉ :  ∶ :  ǃ !  ∕ /  ⁄ /  ∗ *  ‚ ,
"""
#: Code points without a picture of their own, as ranges.
INVISIBLE = "00-08 0B-0C 0E-1F 7F-9F AD 34F 61C 115F-1160 17B4-17B5 180B-180F 200B-200F 202A-202C 2060-2064 2066-206F 3164 FE00-FE0F FEFF FFA0 FFF9-FFFB 1BCA0-1BCA3 1D173-1D17A E0000-E01EF"
#: Kinds of compatibility decomposition whose two sides look alike.
KINDS = ("<wide>", "<narrow>", "<noBreak>", "<font>", "<compat>", "<small>", "<initial>", "<medial>", "<final>", "<isolated>")
#: Compatibility characters that look unlike their decomposition (long s, spacing accents, bracketed signs).
UNLIKE = "17F A8 AF B4 B8 2D8-2DD 37A 384 1E9B 1FBD-1FFE 2017 203E 2474-24B5 249C-24E9 3200-33FF"
#: Joiners shape these scripts, so they stay there: Arabic to Khmer.
JOINED = (0x0600, 0x17FF)

#: Blocks whose look-alikes are only those of ALIKE: in Greek, Cyrillic and Armenian the public data liken letters that readers of these tell apart.
OWN = ((0x370, 0x590),)
#: Characters of a run, and marks, joiners, selectors, vowels and finals that belong to what comes before them.
RUN = 48

_SPECIAL = r"[^\x09\x0A\x0D\x20-\x7E]"
_BOUND = r"[\p{M}\x{1160}-\x{11FF}\x{200C}\x{200D}\x{FE00}-\x{FE0F}\x{E0001}-\x{E01EF}]"
_RUN = rf"[\x20-\x7E]?{_SPECIAL}{{1,{RUN}}}+{_BOUND}*+"


def _ranges(text: str) -> set[int]:
    out: set[int] = set()
    for part in text.split():
        lo, _, hi = part.partition("-")
        out.update(range(int(lo, 16), int(hi or lo, 16) + 1))
    return out


@lru_cache(maxsize=2)
def _skeletons(spark: SparkSession) -> dict[int, int]:
    """Letters and the ASCII letter of their case they are drawn like, by the public data of the Unicode library that Spark brings; an error without it, as fewer texts would be found alike."""
    letters = [c for c in [*range(0x80, 0x3400), *range(0xA000, 0xAC00), *range(0xF900, 0x1F000)] if unicodedata.category(chr(c)) in ("Lu", "Ll", "Lo")]
    letters = [c for c in letters if not any(lo <= c < hi for lo, hi in OWN) and unicodedata.bidirectional(chr(c)) == "L"]
    letters = [c for c in letters if not re.search(r" WITH |DOTLESS|LONG S|IOTA|CLICK", unicodedata.name(chr(c), ""))]
    plain = [chr(c) for c in range(0x21, 0x7F)]
    builder = getattr(spark._jvm, "com.ibm.icu.text.SpoofChecker$Builder")
    if not isinstance(builder, JavaClass):
        raise RuntimeError("look-alikes need com.ibm.icu.text.SpoofChecker of the Unicode library icu4j, which is not among the jars of this Spark")
    made = builder().build().getSkeleton(0, "\n".join([*plain, *map(chr, letters)])).split("\n")
    if len(made) != len(plain) + len(letters):
        raise RuntimeError(f"the Unicode library gave {len(made)} skeletons for {len(plain) + len(letters)} characters")
    ascii_of: dict[tuple[str, str], str] = {}
    for c, k in zip(plain, made):
        ascii_of.setdefault((k, unicodedata.category(c)), c)
    out = {}
    for c, k in zip(letters, made[len(plain) :]):
        kind = unicodedata.category(chr(c))
        if like := ascii_of.get((k, "Lu" if kind == "Lo" else kind)):
            out[c] = ord(like)
    return out


def NFC(text: str) -> str:
    return unicodedata.normalize("NFC", text)


@lru_cache(maxsize=1)
def compositions() -> list[tuple[str, str]]:
    """(decomposed, composed) of every character that canonical composition makes; Hangul by its rule, from letters and from syllables without a final."""
    rows = []
    for code in [*range(0xC0, 0xAC00), *range(0xF900, 0x30000)]:
        char = chr(code)
        if 0x3400 <= code < 0xA000 or unicodedata.decomposition(char)[:1] in ("", "<"):
            continue
        apart = unicodedata.normalize("NFD", char)
        if len(apart) > 1 and NFC(apart) == char:
            rows.append((apart, char))
    for n in range(11172):
        lead, vowel, final = chr(0x1100 + n // 588), chr(0x1161 + n % 588 // 28), chr(0x11A7 + n % 28)
        rows.append((lead + vowel + (final if n % 28 else ""), chr(0xAC00 + n)))
        if n % 28:
            rows.append((chr(0xAC00 + n - n % 28) + final, chr(0xAC00 + n)))
    return rows


def mapping(spark: SparkSession) -> list[tuple[int, list[tuple[int, int]]]]:
    """(code point, [(code point, combining class)]) of every code point that is not its own plain form; class -1 of starters that belong to the character before them."""
    alike = _skeletons(spark) | {ord(a): ord(b) for a, b in re.findall(r"(\S) (\S)", ALIKE)}
    gone, unlike = _ranges(INVISIBLE), _ranges(UNLIKE)
    tied = {ord(x) for apart, _ in compositions() for x in apart[1:] if not unicodedata.combining(x)}

    def plain(code: int) -> list[int]:
        if code in gone:
            return []
        char = chr(code)
        if unicodedata.category(char) == "Zs":
            return [0x20]
        parts = unicodedata.decomposition(char).split()
        if parts and parts[0][0] == "<":
            parts = parts[1:] if parts[0] in KINDS and code not in unlike else []
        if parts:
            return [x for p in parts for x in plain(int(p, 16))]
        return [alike.get(code, code)]

    rows = []
    for code in [*range(0x20), *range(0x7F, 0xAC00), *range(0xD7A4, 0xD800), *range(0xF900, 0x30000), *range(0xE0000, 0xE0200)]:
        out = plain(code)
        if out != [code] or code in tied or unicodedata.combining(chr(code)):
            rows.append((code, [(c, -1 if c in tied else unicodedata.combining(chr(c))) for c in out]))
    return rows


def _pictograph(code: Column) -> Column:
    return code.between(0x1F000, 0x1FAFF) | code.between(0x2190, 0x2BFF) | code.isin(0xA9, 0xAE, 0x203C, 0x2049, 0x3030, 0x303D, 0x3297, 0x3299)


def plain_runs(spark: SparkSession, runs: DataFrame) -> DataFrame:
    """(run, form) of the distinct runs whose form differs from them."""
    table = F.broadcast(spark.createDataFrame(mapping(spark), "code int, parts array<struct<c: int, ccc: int>>"))
    points = runs.select("run", F.posexplode(F.split("run", "")).alias("pos", "char")).withColumn("code", F.ascii("char"))
    near = Window.partitionBy("run").orderBy("pos")
    points = points.withColumn("last", F.lag("code").over(near)).join(table, "code", "left")
    # Joiners and selectors mean something between pictographs and in joining scripts.
    kept = F.col("code").isin(0x200C, 0x200D, 0xFE0E, 0xFE0F) & (_pictograph(F.col("last")) | F.col("last").isin(0xFE0F) | F.col("last").between(*JOINED))
    kept = F.coalesce(kept | (F.col("code").between(0xE0020, 0xE007F) & (F.col("last") >= 0x1F000)), F.lit(False))
    own = F.array(F.struct(F.col("code").alias("c"), F.lit(0).alias("ccc")))
    pieces = points.withColumn("parts", F.when(kept | F.col("parts").isNull(), own).otherwise(F.col("parts")))
    pieces = pieces.select("run", "pos", "char", "code", F.posexplode_outer("parts").alias("sub", "p"))
    order = Window.partitionBy("run").orderBy("pos", "sub")
    ccc = F.coalesce(F.col("p.ccc"), F.lit(1))
    begins = (ccc == 0) | ((ccc < 0) & (F.last(F.when(F.col("p.c").isNotNull(), ccc), True).over(order.rowsBetween(Window.unboundedPreceding, -1)) > 0))
    pieces = pieces.withColumn("begins", F.when(begins, 1).otherwise(0)).withColumn("base", F.sum("begins").over(order))
    char = F.when(F.col("p.c").isNull(), "").when(F.col("p.c") == F.col("code"), F.col("char")).otherwise(_char(F.col("p.c")))
    # Each starter with what belongs to it, its marks by class. Most compose as a whole, by a join; where only some of the marks do, they are taken one by one.
    piece = F.struct(F.greatest(F.coalesce("p.ccc", F.lit(0)), F.lit(0)).alias("ccc"), "pos", "sub", char.alias("ch"))
    groups = pieces.groupBy("run", "base").agg(F.filter(F.sort_array(F.collect_list(piece)), lambda x: x["ch"] != "").alias("marks"))
    text = lambda marks: F.array_join(F.transform(marks, lambda x: x["ch"]), "")
    groups = groups.withColumn("apart", text(F.col("marks"))).withColumn("root", text(F.filter("marks", lambda x: x["ccc"] == 0)))
    known = F.broadcast(spark.createDataFrame(compositions(), "whole string, composed string"))
    joined = groups.join(known, F.when(F.size("marks") > 1, F.col("apart")) == F.col("whole"), "left")
    roots = known.select(F.col("whole").alias("root"), F.col("composed").alias("syllable"))
    joined = joined.join(roots, "root", "left").withColumn("head", F.coalesce("syllable", "root"))
    steps = {NFC(x[:-1]) + x[-1]: one for x, one in compositions() if unicodedata.combining(x[-1])}
    pairs = F.create_map(*[F.lit(x) for pair in steps.items() for x in pair])

    def take(s: Column, x: Column) -> Column:
        made = F.try_element_at(pairs, F.concat(s["head"], x["ch"]))
        fits = made.isNotNull() & ((s["kept"] == "") | (s["last"] < x["ccc"]))
        return F.struct(
            F.when(fits, made).otherwise(s["head"]).alias("head"), F.when(fits, s["kept"]).otherwise(F.concat(s["kept"], x["ch"])).alias("kept"), F.when(fits, s["last"]).otherwise(x["ccc"]).alias("last")
        )

    start = F.struct(F.substring("head", -1, 1).alias("head"), F.lit("").alias("kept"), F.lit(0).alias("last"))
    one_by_one = F.aggregate(F.filter("marks", lambda x: x["ccc"] > 0), start, take, lambda s: F.concat(s["head"], s["kept"]))
    one_by_one = F.concat(F.substring("head", F.lit(1), F.length("head") - 1), one_by_one)
    out = F.when(F.col("composed").isNotNull(), F.col("composed")).when((F.size("marks") > 2) & (F.col("head") != ""), one_by_one).otherwise(F.col("apart"))
    lists = joined.groupBy("run").agg(F.sort_array(F.collect_list(F.struct("base", out.alias("ch")))).alias("l"))
    return lists.select("run", F.array_join(F.transform("l", lambda x: x["ch"]), "").alias("form")).filter(F.col("form") != F.col("run"))


def _char(code: Column) -> Column:
    """The character of a code point, through UTF-16 so that all planes work."""
    high, low = F.lit(0xD800) + F.shiftright(code - 0x10000, 10), F.lit(0xDC00) + (code - 0x10000).bitwiseAND(0x3FF)
    units = F.when(code < 0x10000, F.lpad(F.hex(code), 4, "0")).otherwise(F.concat(F.hex(high), F.hex(low)))
    return F.decode(F.unhex(units), "UTF-16BE")


def text_forms(texts: DataFrame) -> DataFrame:
    """(text_key, form) of distinct texts (text_key, text): the plain form of each; CRLF and CR are line ends like LF."""
    spark = texts.sparkSession
    stage = Stage(spark, "lookalikes")
    places = texts.filter(F.col("text").rlike(_SPECIAL)).select("text_key", F.posexplode(F.regexp_extract_all("text", F.lit(_RUN), 0)).alias("n", "run"))
    changed = stage.write(plain_runs(spark, places.select("run").distinct()))
    fixed = (
        places.join(changed, "run", "left")
        .groupBy("text_key")
        .agg(F.max(F.col("form").isNotNull()).alias("touched"), F.sort_array(F.collect_list(F.struct("n", F.coalesce("form", "run").alias("r")))).alias("runs"))
        .filter("touched")
        .select("text_key", F.transform("runs", lambda x: x["r"]).alias("runs"))
    )
    plain = F.split("text", _RUN, -1)
    rebuilt = F.array_join(F.flatten(F.zip_with(plain, F.col("runs"), lambda a, b: F.array(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))))), "")
    return texts.join(fixed, "text_key", "left").select("text_key", F.regexp_replace(F.when(F.col("runs").isNull(), F.col("text")).otherwise(rebuilt), r"\r\n?", "\n").alias("form"))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(id, text_key) of the documents and (text_key, text) of their distinct texts, pre-aggregated, so that a text that many documents hold is shuffled once per task."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).withColumn("text_key", F.sha2("text", 256))
    texts = rows.filter(F.col("text").isNotNull()).groupBy("text_key").agg(F.max("text").alias("text"))
    return rows.select("id", "text_key").distinct(), Stage(docs.sparkSession, "texts").write(texts)


def visual_forms(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text_key, form): the plain form of each text and a digest of the text as it is.

    Null texts have a null form. Repeated rows come out once. Letter case, accents and
    the number of spaces are kept. Other columns are ignored.
    """
    ids, texts = _keyed(docs, id_col, text_col)
    return ids.join(text_forms(texts), "text_key", "left").select("id", "text_key", "form")


def visual_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text_key, form_key): texts that look the same share a form_key; null for texts without a visible character."""
    ids, texts = _keyed(docs, id_col, text_col)
    keys = text_forms(texts).select("text_key", F.when(F.col("form").rlike(r"[^\s]"), F.sha2("form", 256)).alias("form_key"))
    return ids.join(keys, "text_key", "left").select("id", "text_key", "form_key")


def lookalike_pairs(classes: DataFrame) -> DataFrame:
    """(id_a, id_b), id_a < id_b, of texts that differ as strings but look the same.

    Classes all of whose texts are equal, however large, drop out in a grouped pass before any pair is made.
    """
    rows = classes.filter(F.col("form_key").isNotNull())
    mixed = rows.groupBy("form_key").agg(F.min("text_key").alias("lo"), F.max("text_key").alias("hi")).filter(F.col("lo") != F.col("hi")).select("form_key")
    left = Stage(rows.sparkSession, "lookalike-pairs").write(rows.join(mixed, "form_key").distinct())
    a, b = left.alias("a"), left.alias("b")
    return (
        a.join(b, (F.col("a.form_key") == F.col("b.form_key")) & (F.col("a.id") < F.col("b.id")) & (F.col("a.text_key") != F.col("b.text_key")))
        .select(F.col("a.id").alias("id_a"), F.col("b.id").alias("id_b"))
        .distinct()
    )
