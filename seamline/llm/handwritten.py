"""Telling hand-written source files from generated, minified and vendored ones and from data kept as code.

Evidence, in this order: where a file lies and what it is called; exact containment of its lines in a file of another
codebase (vendored and then edited copies), found by an inverted index of line hashes; what its opening comment says; the
composition of its text in tokens of a public vocabulary.

Files with the same lines are one class, so a file copied into any number of codebases is one entry of the index. Containment is
exact without comparing pairs: of a file's lines, sorted from rare to common, a copy that holds a share t of them must hold
one of the first n - ceil(t n) + 1, so only those are looked up.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from seamline.llm.tokenizer import VOCABULARIES, Vocabulary, _vocabulary, load_tokens
from seamline.session import Stage

#: Share of a file's lines that a file of another codebase must hold. Files of fewer than LEAST_LINES must be held whole, and one of
#: their lines must be in at most RARE classes.
CONTAINED, LEAST_LINES, RARE = 0.8, 8, 8
#: Code of fewer characters is too little to be judged by its composition.
LEAST_CODE = 300
#: Share of characters in words (tokens of three letters and more): a line with fewer than the first is data, long lines with more than the second prose.
DATA_WORDS, PROSE_WORDS = 0.25, 0.8

#: Folders of third-party code.
VENDORED_PATH = r"(?:^|/)(?:vendor|_vendor|node_modules|bower_components|jspm_packages|third[-_]?party|3rd[-_]?party|site-packages|dist-packages|Godeps|Carthage|Pods|externals?|extern|deps/[^/]+-\d+(?:\.\d+)+|[^/]+\.dist-info)/(?:.*/)?[^/]+$"
#: Folders and names of generated files.
GENERATED_PATH = (
    r"(?:^|/)(?:gen|generated|_generated|__generated__|autogen|auto-gen|codegen-out|gen-src)/|(?:\.pb|_pb|_pb2|_pb2_grpc|\.pb\.gw|_grpc_pb|\.g|\.gen|\.generated|_generated|\.designer|\.auto|_string\.gen|\.auto\.gen)\.[A-Za-z]+$"
    r"|(?:^|/)zz_generated[._][^/]*$|(?:^|/)(?:package-lock\.json|yarn\.lock|pnpm-lock\.yaml|poetry\.lock|Cargo\.lock|go\.sum|Gemfile\.lock|composer\.lock)$|\.lock\.(?:ya?ml|json|hcl)$|\.terraform\.lock\.hcl$"
)
#: Names of minified and bundled files.
MINIFIED_PATH = r"(?:[.-]min|\.bundle|\.chunk|\.packed)\.(?:js|mjs|cjs|css)$|-[0-9a-f]{8,20}\.(?:js|mjs|css)$"
#: Endings of settings and key files, which count as hand-written whatever they are made of.
SETTINGS_PATH = r"\.(?:json|ini|env|netrc|pem|key|crt|cer|pub|properties|toml|conf|cfg|txt|md|lock)$|/\.?(?:netrc|env)$|/\.env\.[^/]*$|/id_[^/.]+$"

_COMMENT = re.compile(r"\s*(?:#|//|/\*|\*|--|;|<!--|%|\"\"\"|''')")
#: Words that turn a sentence about generated or vendored code around, and those that forbid edits.
_NOT = frozenset("nothing not never no none isn't aren't wasn't without".split())
_ORIGIN = frozenset("generated vendored copied imported".split())
_FORBID = re.compile(r"\b(?:do not|don't|never|must not|should not|not to be)\b", re.I)
_EDIT = re.compile(r"\b(?:edit\w*|chang\w+|modif\w+|touch\w*)\b", re.I)
_UNDONE = re.compile(r"\b(?:lost|overwritten|discarded|undone)\b", re.I)
_EDITS = re.compile(r"\b(?:changes|edits|modifications)\b", re.I)
_REMADE = re.compile(r"\bregenerat\w+\b", re.I)
_MADE = re.compile(
    r"\bcode generated\b.*\bdo not edit\b|^\W*@(?:\w+[-_])?(?:auto)?generated\b|^\W*(?:this (?:file|code|module) (?:is|was|has been) )?auto(?:matically)?[- ]?generated\b|^\W*(?://|#)line \d+ \"", re.I
)
_MADE_BY = re.compile(r"^\W*(?:(?:this|the) (?:file|code|module|source) (?:is|was|has been) )?(?:generated|produced|rendered|created|emitted|built|compiled|written|made) (?:by|from|with|using|out of)\b", re.I)
_TAKEN = re.compile(
    r"^\W*(?:(?:this|the) (?:file|code|module) (?:is|was|has been) )?(?:copied|imported|vendored|taken|borrowed|forked|extracted|ported|mirrored|bundled)(?: \w+)? from\b|^\W*upstream\s*:|\blocal copy\b.*\b(?:sync|upstream)\b|\bfixes upstream\b"
    r"|\bthis copy of \S+ (?:may|can|is|must)\b|^\W*vendored\b|^\W*copyright\b.*\b(?:the )?\S+ (?:contributors|authors|developers|project|foundation)\b",
    re.I,
)
_LITERAL = re.compile(r"""0[xX][0-9a-fA-F]+|-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?|[bru]?"(?:[^"\\\n]|\\.)*"|[bru]?'(?:[^'\\\n]|\\.)*'|`[^`\n]*`""")
#: From so many characters on, without long strings in it, a line is none that people write.
LONG_LINE = 300
#: The markers, besides // and those that are closed, that begin a comment in files of these endings.
COMMENT_MARKS = {
    **dict.fromkeys("css scss less js mjs cjs jsx ts mts tsx go java kt swift c h cc cpp hpp cs rs scala dart html htm xml vue svelte".split(), ()),
    **dict.fromkeys("py pyi rb pl sh bash zsh yaml yml tf tfvars hcl toml r jl cmake mk php".split(), ("#",)),
    **dict.fromkeys("sql lua hs elm adb ads vhd vhdl".split(), ("--",)),
    **dict.fromkeys("asm s lisp lsp el clj cljs scm ini".split(), (";", "#")),
    **dict.fromkeys("tex sty erl hrl m".split(), ("%",)),
}
_LONG_STRING = re.compile(r"""\"(?:[^"\\\n]|\\.){80,}+\"|'(?:[^'\\\n]|\\.){80,}+'|`[^`\n]{80,}+`""")
#: Keys and certificates are settings wherever they stand.
_ARMOUR = re.compile(r"-----(BEGIN|END) [A-Z0-9 ]+-----")
_BLOB = re.compile(r"^[A-Za-z0-9+/=_\-]{32,}\W*$")
_RECORD = re.compile(r"^(?:[^,;|\t]*[,;|\t]){2,}[^,;|\t]*$")
_CALLS = re.compile(r"\b(?:if|for|while|return|def|func|function|class|try|else|switch|import|package|resource|module)\b|=>|\bthrow\b")


def opening(text: str) -> str:
    """The comment a text begins with, however long; blank lines belong to it."""
    lines = []
    inside = ""
    for line in text.split("\n"):
        if inside:
            lines.append(line)
            if inside in line:
                inside = ""
        elif not line.strip():
            continue
        elif _COMMENT.match(line):
            lines.append(line)
            if "/*" in line and "*/" not in line:
                inside = "*/"
        else:
            break
    return "\n".join(lines)


def _turned(line: str) -> bool:
    """Whether a line says that something is not generated or vendored, or speaks of what is done by hand."""
    for part in re.split(r"[.;]", line.lower()):
        words = re.findall(r"[\w']+", part)
        seen = [w in _NOT for w in words]
        if True in seen and any(w in _ORIGIN for w in words[seen.index(True) + 1 :]):
            return True
        if any(w in ("generated", "vendored") for w in words) and "by hand" in part:
            return True
    return False


def _warns(line: str) -> bool:
    """Whether a line forbids edits or says that they will be lost."""
    if _REMADE.search(line):
        return True
    for part in line.split("."):
        for first, then in ((_FORBID, _EDIT), (_EDITS, _UNDONE)):
            if (m := first.search(part)) and then.search(part, m.end()):
                return True
    return False


def opening_says(text: str) -> str | None:
    """generated, vendored or None, by the opening comment. What says it is not generated, or speaks of others' output, is no evidence."""
    lines = [x for x in opening(text).split("\n") if not _turned(x)]
    if any(_MADE.search(x) for x in lines):
        return "generated"
    if any(_MADE_BY.search(x) for x in lines) and any(_warns(x) for x in lines):
        return "generated"
    if any(_TAKEN.search(x) for x in lines):
        return "vendored"
    return None


def code_of(line: str, path: str = "") -> str:
    """A line without the comment it begins with, "" if it is nothing else.

    Which markers begin a comment depends on the type of file; where it isn't known, all do, except on lines of LONG_LINE characters.
    """
    bare = line.strip()
    own = COMMENT_MARKS.get(path.rpartition("/")[2].rpartition(".")[2].lower())
    while m := _COMMENT.match(bare):
        mark = m.group().strip()
        closing = {"/*": "*/", "<!--": "-->", '"""': '"""', "'''": "'''"}.get(mark)
        if mark == "*" and not 0 <= bare.find("/*") < bare.find("*/"):
            closing = "*/"  # of a comment that began on an earlier line
        at = bare.find(closing, m.end() - (mark == "*")) if closing else -1
        if at >= 0:
            bare = bare[at + len(closing) :].lstrip()
        elif mark == "*":
            return "" if len(bare) < LONG_LINE and re.match(r"\*(?:[\s*/]|$)", bare) else bare
        elif closing or mark == "//" or (mark in own if own is not None else len(bare) < LONG_LINE):
            return ""
        else:
            return bare
    return bare


def code_lines(text: str, path: str = "") -> list[str]:
    """The lines of a text without leading comments, keys and certificates."""
    parts, at, begun = [], 0, -1
    for m in _ARMOUR.finditer(text):
        if m[1] == "BEGIN":
            begun = m.start()
        elif begun >= 0:
            parts.append(text[at:begun])
            at, begun = m.end(), -1
    parts.append(text[at:])
    return [bare for line in "".join(parts).split("\n") if (bare := code_of(line, path))]


def composition(text: str, path: str = "") -> tuple[int, int, int, int, int, int]:
    """(characters, data characters, white space, lines, characters in long lines, words of control flow) of the code without leading comments, keys and certificates.

    A line is data if little but punctuation is left of it without its literals, or if it is one blob or one record of a table.
    """
    return _composed(code_lines(text, path))


def _composed(code: list[str]) -> tuple[int, int, int, int, int, int]:
    chars = data = space = lines = long_ = flow = 0
    for bare in code:
        lines += 1
        n = len(bare)
        chars += n
        space += sum(map(bare.count, " \t"))
        if n >= LONG_LINE and len(_LONG_STRING.sub("", bare)) >= LONG_LINE:
            long_ += n
        left = sum(c.isalpha() for c in _LITERAL.sub("", bare))
        digits = sum(c.isdigit() for c in bare)
        flow += len(_CALLS.findall(bare))
        if n > 3 and (left <= 0.15 * n or _BLOB.match(bare) or digits >= 0.25 * n and _RECORD.match(bare)):
            data += n
    return chars, data, space, lines, long_, flow


class Tokens:
    """How much of a code is in words, that is in tokens of three letters and more."""

    def __init__(self, vocab: Vocabulary):
        self.vocab = vocab
        plain = [t.decode("utf-8", "replace").strip() for t in vocab.tokens]
        self.size = np.array([len(t) for t in plain], np.int64)
        self.word = np.array([len(t) if len(t) > 2 and t.replace("_", "a").isalpha() else 0 for t in plain], np.int64)

    def measure(self, code: list[str]) -> tuple[int, int, int]:
        """(characters in tokens, characters in words, lines of which at most DATA_WORDS is in words), white space aside."""
        total = words = listed = 0
        for line in code:
            ids = np.array(self.vocab.encode(line), np.int64)
            size, word = int(self.size[ids].sum()), int(self.word[ids].sum())
            total, words, listed = total + size, words + word, listed + (word <= DATA_WORDS * size)
        return total, words, listed


#: Lines (but for long ones) that are comments, literals, runs that no word is as long as, long lines, the opening comment, and words in which
#: an opening comment speaks of its origin.
_SQL_COMMENT = rf"(?m)^[ \t]*+(?:#|//|\*|--|;|%|/\*|<!--).{{0,{LONG_LINE}}}$"
_SQL_LITERAL = r"\"[^\"\n]*+\"|'[^'\n]*+'|`[^`\n]*+`|0[xX][0-9a-fA-F]+"
_SQL_BLOB, _SQL_LONG = r"(?<![A-Za-z0-9+/=])[A-Za-z0-9+/=]{32}", rf"(?m)^[^\n]{{{LONG_LINE}}}"
_SQL_OPENING = r"\A(?:\s*+(?:/\*(?:[^*]|\*(?!/))*+\*/|(?:#|//|/?\*|--|;|<!--|%|\"{3}|'{3})[^\n]*+))*+"
_SQL_CUE = r"(?i)generat|produced|rendered|created|emitted|built|compiled|written|made |copied|imported|vendored|taken|borrowed|forked|extracted|ported|mirrored|bundled|upstream|local copy|this copy of|copyright|line \d"


def chunk_facts(chunks: DataFrame, name: str = "byte_bpe_50k", folder: str = VOCABULARIES) -> DataFrame:
    """One row per chunk with a path: (cwd, file_path, start_line, dated, says, chars, data, space, lines, long_chars, flow, tokens, words, listed).

    Plain expressions count each chunk's characters and pick those that may hold data or minified code (long lines, blobs, less than half letters
    outside literals) or an opening that speaks of its origin; only these are read in Python. The others count as words.
    """
    shared = chunks.sparkSession.sparkContext.broadcast(load_tokens(f"{folder}/{name}.tiktoken"))
    names = ["cwd", "file_path", "start_line", "dated", "says", "chars", "data", "space", "lines", "long_chars", "flow", "tokens", "words", "listed"]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens(_vocabulary(shared.value))
        for b in batches:
            says, made = [], []
            for text, path, head, size, lines in zip(*(b.column(c).to_pylist() for c in ("content", "file_path", "head", "size", "n_lines"))):
                says.append(opening_says(head) if head else None)
                if text is not None:
                    code = code_lines(text, path)
                    made.append(_composed(code) + tokens.measure(code))
                else:
                    made.append((size, 0, 0, lines, 0, 0, size, size, 0))
            cols = [b.column(c) for c in names[:4]] + [pa.array(says, pa.string())] + [pa.array([m[k] for m in made], pa.int64()) for k in range(9)]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    text = F.coalesce("content", F.lit(""))
    rows = chunks.filter(F.col("file_path").isNotNull()).select("cwd", "file_path", "start_line", F.col("created_at").cast("timestamp").alias("dated"), text.alias("content"), F.regexp_extract(text, _SQL_OPENING, 0).alias("head"), F.regexp_replace(text, _SQL_COMMENT, "").alias("bare"))
    rows = rows.withColumn("size", F.length(F.regexp_replace("bare", r"\s+", "")))
    letters = F.length(F.regexp_replace(F.regexp_replace("bare", _SQL_LITERAL, ""), "[^A-Za-z]+", ""))
    n_lines = F.length("bare") - F.length(F.replace("bare", F.lit("\n"))) + 1
    odd = (F.col("size") > 0) & ((letters <= 0.5 * F.col("size")) | F.col("bare").rlike(_SQL_LONG) | F.col("bare").rlike(_SQL_BLOB))
    rows = rows.select("cwd", "file_path", "start_line", "dated", F.when(odd, F.col("content")).alias("content"), F.when(F.col("head").rlike(_SQL_CUE), F.col("head")).alias("head"), "size", n_lines.alias("n_lines"))
    return rows.mapInArrow(measure, "cwd string, file_path string, start_line int, dated timestamp, says string, " + ", ".join(f"{c} long" for c in names[5:]))


def path_kind(path: Column, root: Column) -> Column:
    """vendored, generated, minified or null, by the path below the codebase's root."""
    below = F.when(path.startswith(F.concat(root, F.lit("/"))), F.substring(path, F.length(root) + F.lit(2), F.lit(1 << 20))).otherwise(path)
    return F.when(below.rlike(VENDORED_PATH), "vendored").when(below.rlike(GENERATED_PATH), "generated").when(below.rlike(MINIFIED_PATH), "minified")


def file_facts(chunks: DataFrame) -> DataFrame:
    """One row per file: (cwd, file_path, dated, by_path, by_opening, by_made). Repeated rows count once."""
    facts = chunk_facts(chunks).distinct()
    files = facts.groupBy("cwd", "file_path").agg(
        F.min("dated").alias("dated"),
        F.min(F.when(F.col("chars") + F.length(F.coalesce("says", F.lit(""))) > 0, F.struct(F.coalesce("start_line", F.lit(1 << 30)).alias("at"), F.col("says").alias("says")))).alias("first"),
        *[F.sum(c).alias(c) for c in ("chars", "data", "space", "lines", "long_chars", "flow", "tokens", "words", "listed")],
    )
    settings = F.col("file_path").rlike(SETTINGS_PATH)
    enough = F.col("chars") >= LEAST_CODE
    dense = enough & (F.col("long_chars") >= 0.5 * F.col("chars")) & (F.col("space") <= 0.12 * F.col("chars")) & (F.col("words") <= PROSE_WORDS * F.col("tokens"))
    listed = (F.col("listed") >= 0.8 * F.col("lines")) | (F.col("data") >= 0.8 * F.col("chars"))
    tabular = enough & listed & (F.col("flow") <= 0.1 * F.col("lines") + 2)
    return files.select(
        "cwd",
        "file_path",
        "dated",
        path_kind(F.col("file_path"), F.coalesce("cwd", F.lit(""))).alias("by_path"),
        F.col("first.says").alias("by_opening"),
        F.when(settings, None).when(dense, "minified").when(tabular, "data").alias("by_made"),
    )


def line_index(chunks: DataFrame) -> DataFrame:
    """(cwd, file_path, line_hash): the lines of each file that carry some text, white space evened out; a line may come more than once.

    Lines of fewer than 12 characters or 8 letters and digits say nothing about origin and are left out.
    """
    uneven = F.contains("line", F.lit("  "))
    for blank in "\t\r\f\x0b":
        uneven = uneven | F.contains("line", F.lit(blank))
    return (
        chunks.filter(F.col("content").isNotNull() & F.col("file_path").isNotNull())
        .select("cwd", "file_path", F.explode(F.split("content", "\n")).alias("line"))
        .filter((F.length("line") >= 12) & F.col("line").rlike(r"\A(?:[^\p{L}\p{N}]*+[\p{L}\p{N}]){8}"))
        .withColumn("line", F.btrim("line", F.lit(" \t\r\f\x0b")))
        .withColumn("line", F.when(uneven, F.regexp_replace("line", r"\s+", " ")).otherwise(F.col("line")))
        .filter(F.length("line") >= 12)
        .select("cwd", "file_path", F.xxhash64("line").alias("line_hash"))
    )


def _numbered(df: DataFrame) -> DataFrame:
    """With numbers for codebase and file: two 64-bit hashes name a file in 16 bytes."""
    return df.withColumn("c", F.xxhash64("cwd")).withColumn("f", F.xxhash64("file_path"))


CLASS = ["k1", "k2"]


def _first_two(df: DataFrame, key: list[str], order: str) -> DataFrame:
    """(key..., a, b): the least struct `order` of each key, and the least of another codebase (field c); pre-aggregated, so no key is gathered."""
    first = df.groupBy(*key).agg(F.min(order).alias("a"))
    second = df.join(first, key).filter(F.col(f"{order}.c") != F.col("a.c")).groupBy(*key).agg(F.min(order).alias("b"))
    return first.join(second, key, "left")


def find_copies(index: DataFrame, files: DataFrame, contained: float = CONTAINED, least_lines: int = LEAST_LINES, stage: Stage | None = None) -> DataFrame:
    """(cwd, file_path, other_cwd, other_path): each file with one file of another codebase that precedes it and holds `contained` of its lines.

    `files` (cwd, file_path, dated, vendored) names the files. Vendored files precede all others, then earlier ones, then by path; so of any number
    of copies the original stays, and there is at most one link per file. Exact: files with equal lines form a class of which only the first two holders
    count; classes are looked up by their rarest lines, first with the first holder of each line, and only classes with members left without a
    link with all preceding holders. Lines known to one codebase only are counted and dropped, with them all classes that have too many of them.
    """
    stage = stage or Stage(index.sparkSession, "copies")
    far = F.lit("9999-12-31").cast("timestamp")
    named = _numbered(files).select("c", "f", F.struct((~F.col("vendored")).alias("plain"), F.coalesce("dated", far).alias("at"), F.col("file_path").alias("path"), F.col("cwd"), "c").alias("o"))
    h = F.col("line_hash")
    rows = stage.write(_numbered(index).select("c", "f", "line_hash").distinct())
    sets = stage.write(rows.groupBy("c", "f").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64(h, F.lit(1))).alias("k1"), F.bit_xor(F.xxhash64(h, F.lit(2))).alias("k2")).filter(F.col("n") > 1))
    need = F.when(F.col("n") < least_lines, F.col("n")).otherwise(F.ceil(F.lit(contained) * F.col("n")))
    spread = rows.groupBy("line_hash").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter(F.col("lo") != F.col("hi"))
    common = stage.write(rows.join(spread.select("line_hash"), "line_hash"))
    enough = common.groupBy("c", "f").agg(F.count(F.lit(1)).alias("n_shared")).join(sets, ["c", "f"]).filter(F.col("n_shared") >= need).select("c", "f")
    # Of all other files only the lines count that these hold, too.
    common = stage.write(common.join(common.join(enough, ["c", "f"], "left_semi").select("line_hash").distinct(), "line_hash", "left_semi"))
    members = stage.write(common.select("c", "f").distinct().join(sets, ["c", "f"]).join(named, ["c", "f"]))
    ends = members.groupBy(*CLASS).agg(F.max("n").alias("n"), F.min(F.struct("c", "f")).alias("rep"), F.min("c").alias("lo"), F.max("c").alias("hi"))
    classes = stage.write(ends.join(_first_two(members, CLASS, "o"), CLASS))
    lines = common.join(classes.select(F.col("rep.c").alias("c"), F.col("rep.f").alias("f"), *CLASS, "n"), ["c", "f"])
    counted = lines.groupBy("line_hash").agg(F.count(F.lit(1)).alias("n_classes"))
    shared = stage.write(lines.join(counted, "line_hash").select(*CLASS, "line_hash", "n", "n_classes"))
    likely = shared.groupBy(*CLASS).agg(F.count(F.lit(1)).alias("n_shared"), F.min("n_classes").alias("rarest"), F.max(need).alias("need"))
    likely = likely.filter((F.col("n_shared") >= F.col("need")) & ((F.col("need") >= F.ceil(F.lit(contained * least_lines))) | (F.col("rarest") <= RARE)))
    # The classes left, each with its shared lines from rare to common. Those of its own codebase count as the rarest.
    order = Window.partitionBy(*CLASS).orderBy("n_classes", "line_hash")
    own = shared.join(likely, CLASS).withColumn("place", F.row_number().over(order) + F.col("n") - F.col("n_shared"))
    own = stage.write(own.select(*CLASS, "line_hash", "need", (F.col("place") <= F.col("n") - F.col("need") + 1).alias("probe")))
    probes = own.filter("probe").select(*CLASS, "line_hash")
    holders = shared.select("line_hash", F.col("k1").alias("m1"), F.col("k2").alias("m2"))
    other = (F.col("k1") != F.col("m1")) | (F.col("k2") != F.col("m2"))

    def held(candidates: DataFrame) -> DataFrame:
        """(class, o): the first holders of the classes that hold enough of a class's lines."""
        both = candidates.join(own.select(*CLASS, "line_hash", "need"), CLASS).join(holders, ["m1", "m2", "line_hash"])
        found = both.groupBy(*CLASS, "m1", "m2").agg(F.count(F.lit(1)).alias("both"), F.max("need").alias("need")).filter(F.col("both") >= F.col("need"))
        firsts = found.join(classes.select(F.col("k1").alias("m1"), F.col("k2").alias("m2"), "a", "b"), ["m1", "m2"])
        return firsts.select(*CLASS, F.explode(F.array("a", "b")).alias("o")).filter(F.col("o").isNotNull())

    def links(of: DataFrame, firsts: DataFrame) -> DataFrame:
        """The members with a preceding holder in another codebase."""
        best = of.join(_first_two(firsts, CLASS, "o"), CLASS).withColumn("h", F.when(F.col("a.c") != F.col("c"), F.col("a")).otherwise(F.col("b")))
        return best.filter(F.struct("h.plain", "h.at", "h.path") < F.struct("o.plain", "o.at", "o.path")).select("c", "f", F.col("o.cwd").alias("cwd"), F.col("o.path").alias("file_path"), F.col("h.cwd").alias("other_cwd"), F.col("h.path").alias("other_path"))

    equal = classes.join(likely.select(*CLASS), CLASS).filter(F.col("lo") != F.col("hi")).select(*CLASS, F.explode(F.array("a", "b")).alias("o")).filter(F.col("o").isNotNull())
    firsts = holders.join(probes.select("line_hash").distinct(), "line_hash").join(classes.select(F.col("k1").alias("m1"), F.col("k2").alias("m2"), "a"), ["m1", "m2"])
    firsts = firsts.select("line_hash", F.struct("a.plain", "a.at", "a.path", "a.c", "m1", "m2").alias("x"))
    lead = _first_two(firsts, ["line_hash"], "x").select("line_hash", F.explode(F.array("a", "b")).alias("x")).filter(F.col("x").isNotNull()).select("line_hash", "x.m1", "x.m2")
    tried = stage.write(probes.join(lead, "line_hash").filter(other).select(*CLASS, "m1", "m2").distinct())
    known = stage.write(equal.unionByName(held(tried)))
    easy = stage.write(links(members, known))
    # Members left without a link: the holders of their probes that precede the last of them.
    left = members.join(likely.select(*CLASS), CLASS).join(easy.select("c", "f"), ["c", "f"], "left_anti").groupBy(*CLASS).agg(F.max(F.struct("o.plain", "o.at", "o.path")).alias("last"))
    before = classes.select(F.col("k1").alias("m1"), F.col("k2").alias("m2"), F.col("a").alias("ma"))
    rest = probes.join(left, CLASS).join(holders, "line_hash").filter(other).join(before, ["m1", "m2"])
    rest = rest.filter(F.struct("ma.plain", "ma.at", "ma.path") < F.col("last")).select(*CLASS, "m1", "m2").distinct().join(tried, [*CLASS, "m1", "m2"], "left_anti")
    hard = links(members.join(easy.select("c", "f"), ["c", "f"], "left_anti"), held(stage.write(rest)))
    return easy.unionByName(hard).select("cwd", "file_path", "other_cwd", "other_path")


def classify_files(chunks: DataFrame) -> DataFrame:
    """(cwd, file_path, kind, evidence): vendored, generated, minified, data or handwritten for every file of the chunks, and by what: path, copy, opening, tokens or none.

    A file whose lines another codebase's file holds is a vendored copy if that one is vendored, else if it is the later of
    the two (by the earliest time of its chunks, then by path), so that the original stays. Files without text are judged by their
    path alone; rows without a path are left out; repeated rows count once; other columns are ignored.
    """
    stage = Stage(chunks.sparkSession, "handwritten")
    facts = stage.write(file_facts(chunks))
    vendored = (F.coalesce("by_path", F.lit("")) == "vendored") | (F.coalesce("by_opening", F.lit("")) == "vendored")
    links = find_copies(line_index(chunks), facts.select("cwd", "file_path", "dated", vendored.alias("vendored")), stage=stage)
    copied = links.select(F.col("cwd").alias("_c"), F.col("file_path").alias("_f"), F.lit("vendored").alias("by_copy"))
    found = facts.join(copied, F.col("cwd").eqNullSafe(F.col("_c")) & (F.col("file_path") == F.col("_f")), "left")
    by = [("by_path", "path"), ("by_copy", "copy"), ("by_opening", "opening"), ("by_made", "tokens")]
    evidence = F.coalesce(*[F.when(F.col(c).isNotNull(), e) for c, e in by], F.lit("none"))
    return found.select("cwd", "file_path", F.coalesce(*[c for c, _ in by], F.lit("handwritten")).alias("kind"), evidence.alias("evidence"))
