import random
import unicodedata

import tiktoken
from tokenizers import Tokenizer

from seamline.llm.tokenizer import PATTERN, VOCABULARIES, decode_corpus, encode_corpus, load_tokens, vocabulary


def public():
    t = Tokenizer.from_file(f"{VOCABULARIES}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return t


def texts():
    rng, v = random.Random(5), vocabulary()
    out = ["", " ", "a", "<|endoftext|> x", "don't I'll", "\r\n\t  x", "=" * 5000, "ab" * 3000, "é" * 500, "日本語 text 🎉👩‍💻", "x\u0000y", "  　 "]
    for _ in range(3000):
        kind = rng.random()
        if kind < 0.4:
            out.append("".join(rng.choice("abcdefst n'1.") for _ in range(rng.randrange(60))))
        elif kind < 0.7:
            out.append("".join(v.tokens[rng.randrange(256, len(v.tokens))].decode("latin-1") for _ in range(rng.randrange(8))))
        else:
            out.append("".join(chr(rng.choice([rng.randrange(1, 0x250), rng.randrange(0x370, 0xD7FF), rng.randrange(0x10000, 0x1FAFF)])) for _ in range(rng.randrange(20))))
    # Libraries differ in whether code points not yet assigned are letters.
    return [t for t in out if not any(unicodedata.category(c) == "Cn" for c in t)]


def test_ids_equal_those_of_the_public_library():
    v, t = vocabulary(), public()
    for text in texts():
        assert v.encode(text) == t.encode(text, add_special_tokens=False).ids, ascii(text[:80])
        assert v.decode(v.encode(text)) == text


def test_another_vocabulary():
    tokens = load_tokens(f"{VOCABULARIES}/byte_bpe_multi_50k.tiktoken")
    t = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks={x: i for i, x in enumerate(tokens)}, special_tokens={})
    v = vocabulary("byte_bpe_multi_50k")
    for text in texts()[:800]:
        assert v.encode(text) == t.encode_ordinary(text)


def test_every_token_is_its_own_encoding():
    v = vocabulary()
    bad = [i for i, token in enumerate(v.tokens) if v._piece(token.decode("latin-1")) != [i]]
    assert not bad


def test_corpus(spark):
    long = "word " * 400_000
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "Hello world", "x"), (3, "Hello world", "x"), (None, "a", "x"), (5, long, "x")], "doc_id bigint, text string, ids string")
    got = [(r.doc_id, r.ids) for r in encode_corpus(df).collect()]
    assert len(got) == 6 and dict(got)[1] == dict(got)[2] == [] and dict(got)[3] == [15496, 995] and len(dict(got)[5]) == 400_001
    assert {r.doc_id: r.n_tokens for r in encode_corpus(df, counts_only=True).collect()} == {1: 0, 2: 0, 3: 2, None: 1, 5: 400_001}
    back = {r.doc_id: r.text for r in decode_corpus(encode_corpus(df)).collect()}
    assert back[1] == "" and back[3] == "Hello world" and back[5] == long
    assert encode_corpus(df.limit(0)).count() == 0
