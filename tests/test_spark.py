"""The operators as DataFrame expressions and plans."""

import os
import random

import pytest
from pyspark.sql import functions as F
from tests.test_core import BYTES, CASES, CHAT, RANKS, chat, pieces

import __spark_entry__ as entry
from tokloom import encoding as E
from tokloom.functions import grammars as G
from tokloom.functions import specials as S
from tokloom.functions import table, unicode
from tokloom.functions import tokens as T
from tokloom.plans import corpus
from tokloom.session import save, scratch_dir
from tokloom.sources import blob as B
from tokloom.sources import importer as I
from tokloom.streaming import encode as streaming

ODD = ["", " ", "hello world", "I'm don't", "1234 12", "a!!\n", "a   b", "\n  ", "\t \r\n\r\n x", " 　x y", "camelCase ABCd", "日本語 テスト한국어", "é ö é", "ࡰࡱ x", "'ſ 'S", "🦊🚀 !", "٣٤٥٦", "x" * 3000, " " * 500, "a\x0bb\x85c", "a​b", "don't//\n/x"]


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame(list(enumerate([*ODD, None])), "id long, text string")


@pytest.mark.parametrize("grammar", list(G.Grammar))
def test_jvm_pieces_equal_those_of_another_engine(texts, grammar):
    for r in texts.select("text", G.pretokenize(F.col("text"), grammar).alias("p")).collect():
        assert r["p"] == (None if r["text"] is None else pieces(r["text"], grammar)), repr(r["text"])


def test_piece_cases(spark):
    for g, t, want in CASES:
        assert spark.createDataFrame([(t,)], "t string").select(G.pretokenize(F.col("t"), g)).first()[0] == want


def test_random_pieces(spark):
    rng = random.Random(1)
    alphabet = ["a", "B", "é", "ǅ", "ʰ", "字", "1", "٣", "Ⅷ", " ", "\n", "\r", "\t", " ", " ", "'", "s", "/", ".", "_", "́", "🦊", "ࡰ", "ſ", "\U00010d4a"]
    rows = [(i, "".join(rng.choice(alphabet) for _ in range(rng.randrange(30)))) for i in range(1500)]
    df = spark.createDataFrame(rows, "id int, t string")
    for g in G.Grammar:
        for r in df.select("t", G.pretokenize(F.col("t"), g).alias("p")).collect():
            assert r["p"] == pieces(r["t"], g) and "".join(r["p"]) == r["t"], repr(r["t"])


def test_offsets_are_bytes(texts):
    data = {r["id"]: r["text"].encode() for r in texts.collect() if r["text"] is not None}
    for r in G.offsets(texts, "text", G.Grammar.CL100K, "id").collect():
        assert data[r["id"]][r["start"] : r["end"]].decode() == r["piece"]


def test_classes_have_unicode_17_sizes(spark):
    assert {r["class"]: r["total"] for r in unicode.drift(spark).collect()} == {"letter": 145672, "number": 1924, "space": 25, "upper": 145932, "lower": 146298}
    cp = spark.createDataFrame([(0x870,), (0x41,)], "cp int")
    hit = cp.join(F.broadcast(unicode.range_table(spark).where("class = 'letter'")), F.expr("cp BETWEEN low AND high"), "left_semi")
    assert [r["cp"] for r in hit.collect()] == [0x870]


def test_nfc(texts):
    import unicodedata

    for r in texts.select("text", unicode.nfc(F.col("text")).alias("n")).collect():
        assert r["n"] == (None if r["text"] is None else unicodedata.normalize("NFC", r["text"]))


def test_encode_count_decode_columns(texts):
    for e in (E.bytes256(), E.toy(), chat(nfc=True)):
        both = texts.select("text", T.encode_ordinary(F.col("text"), e).alias("i"), T.count_tokens(F.col("text"), e).alias("n")).withColumn("back", T.decode(F.col("i"), e))
        for r in both.collect():
            if r["text"] is None:
                assert r["i"] is None and r["n"] is None and r["back"] is None
            else:
                assert r["i"] == e.encode_ordinary(r["text"]) and r["n"] == len(r["i"]) and r["back"] == e.normalize(r["text"])


def test_special_columns(spark):
    rows = [("x<|go|>abc",), ("é<|end|>s",), ("plain",), ("",), (None,)]
    df = spark.createDataFrame(rows, "t string")
    e, names = chat(), [n for n, _ in CHAT]
    got = df.select(T.encode_with_special(F.col("t"), e).alias("a"), T.try_encode(F.col("t"), e, ["<|go|>"]).alias("b"), S.first(F.col("t"), names).alias("f")).collect()
    assert [r["a"] for r in got] == [None if t is None else e.encode_with_special(t) for (t,) in rows]
    assert got[1]["b"].asDict() == {"ids": None, "error_token": "<|end|>s", "error_offset": 2} and got[0]["b"]["ids"] == [120, 1002, 257]
    assert [None if r["f"] is None else tuple(r["f"]) for r in got] == [("<|go|>", 1), ("<|end|>s", 2), None, None, None]
    with pytest.raises(Exception, match="disallowed special token"):
        df.select(T.encode(F.col("t"), e)).collect()
    with pytest.raises(ValueError):
        T.try_encode(F.col("t"), e, "some")
    parts = S.segments(df.limit(2), "t", names, "t").orderBy("t", "seg").collect()
    assert [(r["part"], r["special"]) for r in parts] == [("x", False), ("<|go|>", True), ("abc", False), ("é", False), ("<|end|>s", True)]
    assert {(r["name"], r["n"]) for r in S.table(spark, CHAT).collect()} == {("<|alias-of-go|>", 1), ("<|go|>", 2), ("<|end|>", 1), ("<|end|>s", 1)}


def test_permissive_decode_and_byte_input(spark):
    df = spark.createDataFrame([(1, [97, 300, 301]), (2, [257, 255]), (3, []), (4, None)], "k int, ids array<long>")
    e = E.toy()
    got = {r["k"]: (r["r"]["bytes"], r["r"]["invalid_id"]) if r["r"] else None for r in df.select("k", T.try_decode(F.col("ids"), e).alias("r")).collect()}
    assert got == {1: (None, 300), 2: (bytearray(b"abc\xff"), None), 3: (bytearray(), None), 4: None}
    assert df.where("k = 2").select(T.decode(F.col("ids"), e)).first()[0] == "abc�"
    with pytest.raises(Exception, match="invalid token id 300"):
        df.select(T.decode_bytes(F.col("ids"), e)).collect()
    assert [r[0] for r in df.orderBy("k").select(T.decode_status(F.col("ids"), e)["status"]).collect()] == [T.DECODE, T.OK, T.OK, T.NULL]
    raw = spark.createDataFrame([(bytearray(b"ab"),), (bytearray(b"\xff"),), (None,)], "b binary")
    got = raw.select(T.encode_utf8(F.col("b"), e).alias("r"), T.count_utf8(F.col("b"), e).alias("n")).collect()
    assert [(r["r"]["value"], r["r"]["status"], r["n"]) for r in got] == [([256], T.OK, 1), (None, T.UTF8, -1), (None, T.NULL, -1)]


def test_set_plans_equal_row_plans(texts):
    for e in (E.toy(), chat(nfc=True), E.Encoding("q", BYTES.items(), grammar=G.Grammar.QWEN)):
        rows = texts.select("id", F.posexplode(T.encode_ordinary(F.col("text"), e)).alias("pos", "tok")).withColumnRenamed("tok", "id2")
        tokens = corpus.encode_set(texts.withColumnRenamed("id", "key"), "text", e, "key")
        assert sorted(map(tuple, tokens.collect())) == sorted(map(tuple, rows.collect()))
        back = {r["key"]: r["bytes"].decode() for r in corpus.decode_set(tokens, e, "key").collect()}
        assert back == {r["id"]: e.normalize(r["text"]) for r in texts.collect() if r["text"]}
        assert corpus.differences(tokens, tokens, ["key"], "id").count() == 0
    bad = corpus.decode_set(tokens.withColumn("id", F.when(F.col("pos") == 1, 9999).otherwise(F.col("id"))), e, "key").collect()
    assert {r["invalid_id"] for r in bad} == {None, 9999} and all((r["bytes"] is None) == (r["invalid_id"] is not None) for r in bad)


def test_flat_offsets(spark):
    rng = random.Random(2)
    rows = [(k, rng.randrange(5)) for k in rng.sample(range(-300, 1000), 200)]
    got = {r["k"]: (r["start"], r["end"]) for r in corpus.flat_offsets(spark.createDataFrame(rows, "k long, n int"), "k", "n").collect()}
    at = 0
    for k, n in sorted(rows):
        assert got[k] == (at, at + n)
        at += n
    assert corpus.flat_offsets(spark.createDataFrame([], "k long, n int"), "k", "n").count() == 0


def test_corpora(spark):
    df = spark.createDataFrame([(1, "a\n\n\n\nb\nc\r\nd\n"), (2, ""), (3, None), (4, "\n")], "k int, t string")
    assert [(r["k"], r["text"]) for r in corpus.paragraphs(df, "t", "k").collect()] == [(1, "a"), (1, "b\nc\r\nd\n"), (4, "\n")]
    want = [(r[0], x) for r in df.collect() if r[1] is not None for x in r[1].replace("\r\n", "\n").split("\n")[: -1 if r[1].endswith("\n") or not r[1] else None]]
    assert [(r["k"], r["text"]) for r in corpus.lines(df, "t", "k").collect()] == want


def test_profile_and_statistics(spark):
    df = spark.createDataFrame([("ab ab abx x",)], "t string")
    r = corpus.profile(df, "t", E.toy()).first()
    assert r.asDict() == {"pieces": 4, "single_byte": 0, "whole_hit": 1, "merged": 3, "tokens": 1 + 2 + 3 + 2, "distinct_pieces": 4}
    s = corpus.statistics(spark.createDataFrame([(1.0,), (2.0,), (6.0,)], "v double"), "v").first()
    assert (s["n"], s["least"], s["median"], s["mean"]) == (3, 1.0, 2.0, 3.0) and abs(s["stdev"] - 7**0.5) < 1e-9
    assert corpus.throughput(2**20, 1.0) == {"mb_s": 1.048576, "mib_s": 1.0}


def test_sources(spark, tmp_path):
    spark.dataSource.register(B.StbSource)
    rows = [("rank", bytes([b]), b) for b in range(256)] + [("special", b"<|x|>", 300)]
    df = spark.createDataFrame(rows, "kind string, token binary, id int")
    path = str(tmp_path / "v.stb")
    df.write.format("stb").option("name", "v").option("grammar", "2").mode("append").save(path)
    assert sorted((r[0], bytes(r[1]), r[2]) for r in spark.read.format("stb").load(path).collect()) == sorted(rows)
    assert E.Encoding.load(tmp_path, "v").grammar is G.Grammar.QWEN
    (tmp_path / "a.tiktoken").write_text("YQ== 0\nYWI= 1\n")
    (tmp_path / "a.special").write_text("<|a b|> 7\n")
    assert [(bytes(r[0]), r[1]) for r in B.read_ranks(spark, str(tmp_path / "a.tiktoken")).collect()] == [(b"a", 0), (b"ab", 1)]
    assert [tuple(r) for r in B.read_specials(spark, str(tmp_path / "a.special")).collect()] == [("<|a b|>", 7)]
    (tmp_path / "bad.tiktoken").write_text("YQ==\n")
    with pytest.raises(Exception, match="malformed line"):
        B.read_ranks(spark, str(tmp_path / "bad.tiktoken")).collect()
    (tmp_path / "f.json").write_text('[{"mode": "ordinary", "ids": [256], "input": "ab"}, {"mode": "with_special", "ids": [1002], "input_b64": "PHxnb3w+"}, {"mode": "ordinary", "ids": [1], "input": "x"}]')
    bad = I.mismatches(I.read_fixtures(spark, str(tmp_path / "f.json")), chat()).collect()
    assert [(r["input"], r["got"]) for r in bad] == [("x", [120])]


def test_sql_surface(spark):
    T.register(spark, chat(), "t_")
    table.register_tokens(spark, E.toy(), "t_rows")
    r = spark.sql("SELECT t_encode('ab<|go|>') a, t_encode_special('ab<|go|>') b, t_count('abc d') n, t_decode(array(257, 33)) d, t_n_vocab() v, t_vocab_size() s").first()
    assert r["b"] == [256, 1002] and len(r["a"]) == 7 and (r["n"], r["d"], r["v"], r["s"]) == (3, "abc!", 1003, 258)
    got = spark.sql("SELECT pos, id, start, end FROM (SELECT 'éab' AS x), LATERAL t_rows(x)").collect()
    assert [tuple(x) for x in got] == [(0, 195, 0, 1), (1, 169, 1, 2), (2, 256, 2, 4)]


def test_streams_equal_batches(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    docs.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = streaming.read(spark, str(tmp_path / "in"), docs.schema, maxFilesPerTrigger="1")
    streaming.write(streaming.encoded(stream, "text", E.toy(), "doc_id"), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    batch = docs.select("doc_id", T.encode_ordinary(F.col("text"), E.toy()).alias("ids")).withColumn("n_tokens", F.size("ids"))
    assert spark.read.parquet(str(tmp_path / "out")).exceptAll(batch).count() == 0 and spark.read.parquet(str(tmp_path / "out")).count() == docs.count()


def test_configured_folder(spark, tmp_path):
    (tmp_path / "mine.stb").write_bytes(E.toy().to_blob().to_bytes())
    spark.conf.set(E.FOLDER_CONF, str(tmp_path))
    try:
        assert E.get_encoding("mine", spark).n_vocab == 258
    finally:
        spark.conf.unset(E.FOLDER_CONF)


def test_saved_tables_lie_in_the_shared_folder(spark):
    df = save(spark.range(3).toDF("x"), "t")
    assert df.count() == 3 and scratch_dir(spark).startswith(spark.conf.get("spark.checkpoint.dir"))


def test_no_query_reads_a_text_twice_or_all_columns(spark, sf_dir):
    plan = entry.queries()["bpe_count"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan and "Exchange" not in plan


own = [n for n in entry.oracle_sql() if not n.startswith("op") and n != "pipeline"]


@pytest.mark.skipif(not os.path.exists(RANKS), reason="no vocabulary file")
@pytest.mark.parametrize("name", own)
def test_query_equals_sql(spark, sf_dir, name):
    import duckdb

    c = duckdb.connect()
    for t in ("documents", "conversations", "benchmark", "pages", "lineitem", "events"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    want = c.sql(entry.oracle_sql()[name])
    df = entry.queries()[name](spark, sf_dir)
    columns = sorted(df.columns)
    assert sorted(want.columns) == columns
    at = [want.columns.index(x) for x in columns]
    norm = lambda v: round(v, 6) if isinstance(v, float) else v
    assert sorted(repr([norm(r[x]) for x in columns]) for r in df.collect()) == sorted(repr([norm(r[k]) for k in at]) for r in want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() == 20
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_long_texts_crash_nothing(spark):
    """Runs that overflow the stack of a backtracking expression, and wide and narrow characters by turns in a text of 10 MB."""
    blanks, wide = " " * 10**6, "a\U0001f600" * 1_700_000
    df = spark.createDataFrame([(1, blanks), (2, blanks + "\x01x"), (3, "<|go|>" + blanks + "<|end|>"), (4, "\x01")], "k int, t string")
    e = chat()
    got = df.select("k", T.encode_with_special(F.col("t"), e).alias("a"), T.count_tokens(F.col("t"), e).alias("n")).collect()
    assert {r["k"]: (len(r["a"]), r["n"]) for r in got} == {1: (10**6, 10**6), 2: (10**6 + 2, 10**6 + 2), 3: (10**6 + 2, 10**6 + 13), 4: (1, 1)}
    for g in G.Grammar:
        assert df.where("k < 3").select(F.size(G.pretokenize(F.col("t"), g)).alias("n")).count() == 2
        assert [r["n"] for r in G.offsets(df.where("k = 1"), "t", g).groupBy().agg(F.max("end").alias("n")).collect()] == [10**6]
    parts = S.segments(spark.createDataFrame([("<|go|>" + wide + "<|end|>",)], "t string"), "t", ["<|go|>", "<|end|>"]).select("seg", F.octet_length("part").alias("n")).collect()
    assert [(r["seg"], r["n"]) for r in parts] == [(0, 6), (1, 5 * 1_700_000), (2, 7)]


def test_flat_batches_have_a_place_for_every_row(spark):
    rows = [(None, 5), (1, 2), (7, 3), (7, None), (1 << 40, 1), (-3, 4), (None, 0)]
    df = spark.createDataFrame(rows, "k long, n long")
    got = sorted((r["start"], r["end"], r["k"] is None, r["k"] or 0) for r in corpus.flat_offsets(df, "k", "n").collect())
    assert len(got) == len(rows) and got[0][0] == 0 and got[-1][1] == 15 and all(a[1] == b[0] for a, b in zip(got, got[1:], strict=False))
    assert [g[3] for g in got if not g[2]] == sorted(g[3] for g in got if not g[2]) and [g[2] for g in got[-2:]] == [True, True]
    index = sorted(map(tuple, corpus.flat_index(df, "k", "n").collect()))
    assert [i for i, _ in index] == list(range(8)) and index[0] == (0, 0) and index[-1] == (7, 15) and [o for _, o in index] == sorted(o for _, o in index)
    assert [tuple(r) for r in corpus.flat_index(df.limit(0), "k", "n").collect()] == [(0, 0)] and corpus.flat_offsets(df.limit(0), "k", "n").count() == 0
    texts = spark.createDataFrame([(3, "xab"), (1, "abc"), (2, None), (None, "a"), (4, "")], "k int, t string")
    assert sorted(map(tuple, corpus.flat_tokens(texts, "t", E.toy(), "k").collect())) == [(0, 257), (1, 120), (2, 256), (3, 97)]
    assert E.toy().encode_flat(["abc", "xab", "a"])[0].tolist() == [257, 120, 256, 97]


def test_one_key_that_most_rows_have_is_many_tasks(spark):
    df = spark.range(0, 40000, 1, 8).selectExpr("if(id % 3 = 0, id, 7) k", "1L n")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so little data would be one partition
    try:
        out = corpus.flat_offsets(df, "k", "n")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    starts = sorted(r["start"] for r in out.collect())
    assert starts == list(range(40000))
    parts = spark.read.parquet(_newest(spark, "numbered")).groupBy("_p").count().collect()
    assert max(r["count"] for r in parts) < 20000


def _newest(spark, name):
    from tokloom import session

    return [p for p in session._saved if f"/{name}-" in p][-1]


def test_tables_of_a_stage_are_deleted(spark):
    from tokloom import session

    df = spark.range(5)
    with session.passing_tables(spark) as keep:
        a = session.save(df, "a")
        b = keep(session.save(df, "b"))
    assert b.count() == 5 and not os.path.exists(a._tokloom_path)
    session.drop(b)
    session.drop(df)
    assert not os.path.exists(b._tokloom_path) and session.is_folder(spark, scratch_dir(spark))


def test_plans_without_a_shuffle(texts):
    for plan in (G.offsets(texts, "text", G.Grammar.O200K, "id"), corpus.token_rows(texts, "text", E.toy(), "id")):
        assert "Exchange" not in plan._jdf.queryExecution().executedPlan().toString()


def test_frequent_pieces_and_the_rest(spark, monkeypatch):
    df = spark.createDataFrame([(1, "the cat the dog " + "z" * 90), (2, "the the the"), (3, ""), (4, None)], "key int, text string")
    want = sorted(map(tuple, corpus.token_rows(df, "text", E.toy(), "key").collect()))
    assert sorted(map(tuple, corpus.encode_set(df, "text", E.toy(), "key").collect())) == want
    monkeypatch.setattr(corpus, "FREQUENT", 1)
    assert sorted(map(tuple, corpus.encode_set(df, "text", E.toy(), "key").collect())) == want
    monkeypatch.setattr(corpus, "BROADCAST_BYTES", 0)
    assert sorted(map(tuple, corpus.encode_set(df, "text", E.toy(), "key").collect())) == want


def test_golden_vectors_without_a_vocabulary(spark, tmp_path):
    import base64
    import json

    rows = [("ab cd", [1, 2]), ("ab", [1]), ("ab!", [3, 4]), ("x y z", [5]), ("cd ab", [6, 7, 8])]
    vectors = [{"mode": "ordinary", "ids": ids, **({"input": t} if k % 2 else {"input_b64": base64.b64encode(t.encode()).decode()})} for k, (t, ids) in enumerate(rows)] + [{"mode": "with_special", "ids": [9], "input": "a b c"}]
    (tmp_path / "v.json").write_text(json.dumps(vectors))
    faults = I.piece_faults(I.read_fixtures(spark, str(tmp_path / "v.json")), G.Grammar.CL100K).collect()
    assert {(r["fault"], r["input"], r["piece"]) for r in faults} == {("pieces", "x y z", None), ("id", None, "ab")}


@pytest.mark.skipif(not os.environ.get("TOKLOOM_GOLDEN"), reason="TOKLOOM_GOLDEN names no folder of golden vectors")
def test_golden_vectors_of_a_folder(spark):
    """Files <encoding>.json of golden vectors: none contradicts its grammar."""
    from pathlib import Path

    for f in sorted(Path(os.environ["TOKLOOM_GOLDEN"]).glob("*.json")):
        if f.stem in B.KNOWN:
            grammar, nfc = B.KNOWN[f.stem]
            vectors = I.read_fixtures(spark, str(f))
            assert vectors.where("mode = 'ordinary'").count() > 0 and I.piece_faults(vectors, G.Grammar(grammar), nfc == 1).collect() == [], f


def test_checksums_of_a_column(spark):
    data = [b"", b"a", b"\x00\xff" * 40, None, "é".encode() * 7]
    df = spark.createDataFrame([(bytearray(x) if x is not None else None,) for x in data], "b binary")
    assert [r[0] for r in df.select(B.checksum(F.col("b"))).collect()] == [None if x is None else f"{B.fnv1a(x):016x}" for x in data]


def test_longest_matches_by_plans(spark):
    e = E.Encoding("t", [*BYTES.items(), (b"ab", 256), (b"abc", 257), (b"cd", 258), (b"zzz", 259)])
    table = spark.createDataFrame([("abcd",), ("zzz",), ("q",), ("",), ("zzzab",)], "piece string")
    assert {(r["piece"], r["id"]) for r in corpus.longest_prefixes(table, e).collect()} == {("abcd", 257), ("zzz", 259), ("q", 113), ("zzzab", 259)}
    made = {r["id"]: (r["left"], r["right"]) for r in corpus.splits(spark, e).collect()}
    assert made[256] == (97, 98) and made[257] == (256, 99) and made[259] == (259, 259) and made[97] == (97, 97)
    # ab and cd have no common byte, but in abcd merges make abc first
    pairs = {r["piece"]: (r["first"], r["second"], r["valid"]) for r in corpus.first_pairs(table, e).collect()}
    assert pairs == {"abcd": (257, 100, True), "zzzab": (259, 256, False)}
