import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from cairnkit.exceptions import ChunkingError, EncodingError, TextProcessingError
from cairnkit.functions import text as T
from cairnkit.operators import chunk, clean, dedup, encode
from tests.conftest import rows


def apply(spark, column, *values):
    """What the column function gives for each value, in order."""
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r.x for r in df.select("i", column(F.col("t")).alias("x")).orderBy("i").collect()]


def words_or_characters(text):
    return (text.split(), " ") if " " in text else (list(text), "")


def split_windows(text, most, overlap):
    parts, glue = words_or_characters(text.strip())
    out, at = [], 0
    while parts:
        out.append(glue.join(parts[at : at + most]).strip())
        if at + most >= len(parts):
            break
        at += most - overlap
    return [x for x in out if x]


def pack_lines(text, most, overlap):
    out, held, glue = [], [], ""
    for line in filter(None, (x.strip() for x in text.split("\n"))):
        parts, g = words_or_characters(line)
        if len(parts) > most or not held or g != glue or len(held) + len(parts) > most:
            if held:
                out.append(glue.join(held))
            held, glue = (parts, g) if len(parts) <= most else ([], "")
            if len(parts) > most:
                out += split_windows(line, most, overlap)
        else:
            held = held + parts
    return out + ([glue.join(held)] if held else [])


def join_lines(text, most, overlap):
    out, held = [], ""
    for line in filter(None, (x.strip() for x in text.split("\n"))):
        if len(words_or_characters(line)[0]) > most:
            out += [held] if held else []
            out += split_windows(line, most, overlap)
            held = ""
        elif held and len(words_or_characters(held + "\n" + line)[0]) <= most:
            held += "\n" + line
        else:
            out += [held] if held else []
            held = line
    return out + ([held] if held else [])


def texts(seed, n=150):
    rng = random.Random(seed)
    units = ["word", "一", "二三", "é", "😀", "a b", "x y z", "\n", "\n", " ", "\n \n", "\t", "longer"]
    return ["".join(rng.choice(units) for _ in range(rng.randrange(40))) for _ in range(n)]


@pytest.mark.parametrize(("operator", "model"), [(chunk.fixed_window, split_windows), (chunk.hybrid, pack_lines), (chunk.by_line, join_lines)])
def test_chunkers_equal_their_models(spark, operator, model):
    data = texts(5)
    for most, overlap in ((6, 2), (4, 0), (30, 29)):
        assert apply(spark, lambda t, m=most, o=overlap: operator(t, m, o), *data) == [model(t, most, overlap) for t in data]


def test_chunker_fixtures(spark):
    twenty = " ".join(f"token{i}" for i in range(20))
    assert len(apply(spark, lambda t: chunk.fixed_window(t, 6, 2), twenty)[0]) == 5
    assert apply(spark, lambda t: chunk.by_paragraph(t, 20, 2), "段落一内容\n\n段落二内容", "one\ntwo", "", " \n") == [["段落一内容", "段落二内容"], ["one", "two"], [], []]
    assert apply(spark, lambda t: chunk.by_line(t, 20, 2), "line1\nline2\nline3", None) == [["line1\nline2\nline3"], None]
    assert apply(spark, lambda t: chunk.chunk_text(t, " HYBRID "), "a b\nc d") == [["a b c d"]]
    with pytest.raises(ChunkingError):
        chunk.chunk_text(F.lit("x"), "nope")
    for bad in ((0, 0), (5, 5), (5, 9)):
        with pytest.raises(ChunkingError):
            chunk.hybrid(F.lit("x"), *bad)


def test_semantic_chunks_break_where_meaning_changes(spark):
    docs = spark.createDataFrame([(1, "cat one. cat two. cat three. dog one. dog two. dog three."), (2, "alone here."), (3, "")], "doc_id int, text string")

    def embed(t):
        return F.array((F.length(t) - F.length(F.replace(t, F.lit("cat"), F.lit("")))).cast("double") + 0.01, (F.length(t) - F.length(F.replace(t, F.lit("dog"), F.lit("")))).cast("double") + 0.01)

    got = dict(rows(chunk.semantic(docs, embed, amount=80.0)))
    assert got[2] == ["alone here."] and len(got[1]) == 2 and " ".join(got[1]) == "cat one. cat two. cat three. dog one. dog two. dog three."
    for kind in chunk.BREAKPOINTS:
        assert sum(r.is_break for r in chunk.semantic_breaks(docs, embed, kind=kind, amount=50.0 if kind in ("percentile", "gradient") else 0.5).collect()) > 0
    with pytest.raises(ChunkingError):
        chunk.semantic_breaks(docs, embed, kind="other")


def test_basic_clean_equals_the_rule(spark):
    def model(t):
        t = t.removeprefix("﻿").replace("\r\n", "\n").replace("\r", "\n")
        t = re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "", t)
        return "\n".join(filter(None, (x.strip() for x in t.split("\n"))))

    rng = random.Random(3)
    parts = ["a", "b c", "\n", "\r\n", "\r", "\t", " ", "\x00", "\x7f", "\x0b", "　", " ", "\x85", "\xa0", "é", "﻿"]
    data = ["﻿line1\r\nline2\x00\x7f", "", *["".join(rng.choice(parts) for _ in range(rng.randrange(25))) for _ in range(300)]]
    assert apply(spark, clean.basic_clean, *data) == [model(t) for t in data]
    assert apply(spark, clean.basic_clean, None) == [None]


def test_normalising(spark):
    def model(t, code):
        t = re.sub("[　\xa0   - ]", " ", t)
        t = t if code else "".join(chr(ord(c) - 0xFEE0) if 0xFF01 <= ord(c) <= 0xFF5E else c for c in t)
        t = unicodedata.normalize("NFC", t)
        return "\n".join(re.sub(r"[ \t]{2,}", " ", x).rstrip() for x in t.split("\n")).strip()

    data = ["A！　B", "é  x\t\ty \n z", "plain", "", "。", " a ", "Ķ Ⅷ ﬁ", "  in\n    dent  "]
    assert apply(spark, clean.normalize_prose, *data) == [model(t, False) for t in data]
    assert apply(spark, clean.normalize_code, *data) == [model(t, True) for t in data]
    df = spark.createDataFrame([("A！　B", k) for k in ("text", "code")], "t string, k string")
    assert [r[0] for r in df.select(clean.normalize_for_type(F.col("t"), F.col("k"))).collect()] == ["A! B", "A！ B"]


def test_markdown_and_dispatch(spark):
    assert apply(spark, clean.clean_markdown, "前<!-- multi\nline -->后", "# T  \n\n\n\nx ") == ["前后", "# T\n\nx"]
    df = spark.createDataFrame([("# T\n\n\n\n正文！ <!-- c -->", "markdown"), ("def f():\n    return '！' \n", "code"), ("\x00 ", "text"), (None, "text")], "t string, k string")
    assert [r[0] for r in df.select(clean.clean_text(F.col("t"), F.col("k"))).collect()] == ["# T\n正文!", "def f():\nreturn '！'", "", None]
    assert df.select(clean.clean_text(F.col("t"), F.col("k"), True)).collect()[1][0] == "def f():\n    return '！'"


def test_page_edges(spark):
    pages = [(1, n, f"CONFIDENTIAL HEADER\n正文{n}") for n in range(3)] + [(2, 0, "重复页眉行\nX"), (2, 1, "重复页眉行\nY"), (3, 0, "only page"), (4, 0, ""), (4, 1, None), (5, 0, "a\nsame end"), (5, 1, " \nb\nsame end "), (5, 2, "")]
    got = dict(rows(clean.clean_pages(spark.createDataFrame(pages, "doc_id int, page_no int, page_text string"), ratio=0.6)))
    assert got == {1: "正文0\n\n正文1\n\n正文2", 2: "X\n\nY", 3: "only page", 4: "", 5: "a\n\nb"}


def test_dedup(spark):
    df = spark.createDataFrame([(["A", "B", " A", "C", "B", ""],), (None,), ([],)], "c array<string>")
    assert [r.c for r in dedup.dedup_chunks(df, "c").collect()] == [["A", "B", "C"], None, []]
    near = "网络安全事件响应流程包括发现、分析、遏制、根除与恢复五个阶段，需要持续记录。"
    pair = spark.createDataFrame([([near, near + "。", "完全不同的内容：密码学基础知识与对称加密算法。"],)], "c array<string>")
    for strategy in ("minhash", "jaccard"):
        assert dedup.dedup_chunks(pair, "c", strategy).first().c == [near, "完全不同的内容：密码学基础知识与对称加密算法。"]
    with pytest.raises(TextProcessingError):
        dedup.dedup_chunks(df, "c", "fuzzy")


def test_greedy_equals_the_sequential_rule(spark):
    rng = random.Random(12)
    base = ["".join(rng.choice("abcde ") for _ in range(40)) for _ in range(6)]
    docs = [["".join(c if rng.random() > 0.1 else "z" for c in rng.choice(base)) for _ in range(12)] for _ in range(15)]

    def grams(t):
        t = " ".join(t.split())
        return {t} if len(t) <= 5 else {t[i : i + 5] for i in range(len(t) - 4)}

    def model(texts, th):
        kept = []
        for t in dict.fromkeys(x.strip() for x in texts if x.strip()):
            s = grams(t)
            if all(len(s & g) / len(s | g) < th for _, g in kept):
                kept.append((t, s))
        return [t for t, _ in kept]

    df = spark.createDataFrame([(i, d) for i, d in enumerate(docs)], "i int, c array<string>")
    got = {r.i: r.c for r in df.select("i", dedup.greedy(F.col("c"), 0.4).alias("c")).collect()}
    assert got == {i: model(d, 0.4) for i, d in enumerate(docs)}
    est = [abs((dedup.signature(a) == dedup.signature(b)).mean() - len(grams(a) & grams(b)) / len(grams(a) | grams(b))) for d in docs for a, b in zip(d, d[1:], strict=False)]
    assert max(est) < 0.25 and sum(est) / len(est) < 0.06


def test_encoders(spark):
    import hashlib
    import math

    got = apply(spark, lambda t: encode.fake(t, 40), "alpha", "beta")
    for text, v in zip(("alpha", "beta"), got, strict=True):
        raw = [hashlib.sha256(text.encode()).digest()[i % 32] / 255 for i in range(40)]
        n = math.sqrt(sum(x * x for x in raw))
        assert v == pytest.approx([x / n for x in raw], abs=1e-15)
    assert len(apply(spark, encode.build("fake"), "x")[0]) == 384
    assert apply(spark, lambda t: encode.align(F.array(F.lit(1.0), F.lit(2.0)), 3), "x") == [[1.0, 2.0, 0.0]]
    assert apply(spark, lambda t: encode.align(F.array(F.lit(1.0), F.lit(2.0)), 1), "x") == [[1.0]]
    assert apply(spark, lambda t: encode.normalize(F.array(F.lit(0.0))), "x") == [[0.0]]
    assert apply(spark, lambda t: encode.encode(t, lambda ts: [[len(x), 1] for x in ts]), "ab", None, "c") == [[2.0, 1.0], None, [1.0, 1.0]]
    with pytest.raises(EncodingError):
        encode.build("other")
    with pytest.raises(EncodingError):
        encode.SentenceEncoder()(["x"])


def test_names_and_types(spark):
    paths = ["/a/b.TXT", "/a.b/c", ".profile", "x.tar.gz", "name.", "/q/é.Md", ""]
    assert apply(spark, T.filename, *paths) == ["b.TXT", "c", ".profile", "x.tar.gz", "name.", "é.Md", ""]
    assert apply(spark, T.extension, *paths) == [".txt", "", "", ".gz", "", ".md", ""]
    assert apply(spark, lambda p: T.file_type(T.extension(p), None), *paths) == ["text", None, None, None, None, "markdown", None]
