"""The operators against brute force on small tables: nulls, empty and very long texts, ties, repeats, clashing names."""

import collections
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tessella.llm import embeddings, langid, lines, media, minhash, mixing, packing, pii, token_store, tokens, urls

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, component string, id int, key int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def prose(seed, n=80):
    rng = np.random.default_rng(seed)
    return " ".join(f"w{k}" for k in rng.integers(0, 5000, n))


def texts():
    base = prose(1)
    words = base.split()
    near = " ".join([*words[:40], "changed", *words[41:]])
    far = " ".join([*words[:30], *prose(2).split()[:50]])
    return [base, base, base.upper().replace("W", "w"), near, far, None, "", "   \n", "one two", "ONE two", prose(3, 30_000), "mail a.b@c.de or +49 (30) 123-4567, 10.0.0.255", "4111 1111 1111 1111 and 300.1.1.1"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, "en", f"s{k % 3}" if k % 4 else None, 0, "x", 1, 2) for k, t in enumerate(texts())]
    return spark.createDataFrame([*rows, rows[0], (None, texts()[0], None, "s1", 0, "x", 1, 2)], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def shingles(text):
    w = WORD.findall((text or "").translate({k: k + 32 for k in range(65, 91)}))
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def components(sets, linked):
    root = {k: k for k in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if linked(sets[a], sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
    return root


def test_long_posting_lists(spark):
    """A large group of near copies, and many texts with one passage in common, against brute force."""
    rng, base, rows = np.random.default_rng(5), prose(7, 60).split(), []
    for k in range(60):
        w = list(base)
        for at in rng.integers(0, 60, 2):
            w[at] = f"x{k}{at}"
        rows.append((k, " ".join(w)))
    rows += [(100 + k, " ".join(base[:35] + prose(100 + k, 25).split())) for k in range(40)]
    sets = {k: shingles(t) for k, t in rows}
    want = components(sets, lambda a, b: 100 * len(a & b) >= 75 * len(a | b))
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == want


def test_token_pieces_match_the_library():
    from tokenizers import Tokenizer

    odd = [*[t for t in texts()[:10] if t], "  a  b\n\n c\t\td  \n", "é é x y  z", "x\x1cy \x85z", "ΣΑΣ I'm it'S they'LL don't", "<|endoftext|> a", "x<|startoftext|>Y<|endoftext|><|endoftext|> z", "<|endoftext", "<|<|endoftext|>|>", "日本語 한국어", "12 345 $$$ !!a1b", "İstanbul"]
    for name, kind in (("word_bpe_49k.json", "word"), ("byte_bpe_50k.json", "byte")):
        path = public_tokenizers.path(name)
        tok = Tokenizer.from_file(path)
        own = tokens.Encoder(path, kind)
        for t in odd:
            assert list(np.frombuffer(own.encode(t), "<u4")) == tok.encode(t, add_special_tokens=False).ids


def test_a_column_looks_up_its_distinct_pieces_once():
    import pyarrow as pa
    from tokenizers import Tokenizer

    class Counted(dict):
        asked = 0

        def get(self, *a):
            Counted.asked += 1
            return super().get(*a)

    # Letters before and after marks, combining and other white space, special tokens, nulls, words longer than the memo takes.
    odd = [None, "", " \n", "a,b c, c. (d). it's, e\u0301. e\u0301,e", "\u03a3\u0391\u03a3. \u03a3a, x\x1cy z\x85z\xa0w\u2028v", "<|endoftext|>a, <|endoftext", "q" * 70 + ". " + "ver" * 40, "\u65e5\u672c\u3002 \u0661\u0662. !!a1b \x0b\x0c end.", "<|startoftext|>"]
    for name, kind in (("word_bpe_49k.json", "word"), ("byte_bpe_50k.json", "byte")):
        path = public_tokenizers.path(name)
        want = [Tokenizer.from_file(path).encode(t or "", add_special_tokens=False).ids for t in odd]
        for memo in (2, 400_000):
            own = tokens.Encoder(path, kind, memo)
            for column in (pa.array(odd), pa.array(["zz", *odd])[1:], pa.array(odd, pa.large_string())):
                assert [np.frombuffer(b, "<u4").tolist() for b in own.encode_column(column)] == want
        assert own.encode_column(pa.array([], pa.string())) == []
    own = tokens.Encoder(public_tokenizers.path("word_bpe_49k.json"), "word")
    own.memo, own.find = Counted(), None  # nothing is cut word for word
    column = pa.array(["one two, three. two one"] * 500 + ["four, one."])
    assert len(own.encode_column(column)) == 501 and Counted.asked <= 8  # four words, two marks and nothing
    own.learn = lambda pieces: {p: b"" for p in pieces if 1 / 0}  # nothing is learned again
    assert len(own.encode_column(column)) == 501


def test_a_column_is_cut_at_blanks_as_the_library_cuts():
    import itertools

    import pyarrow as pa
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    # Every order of blanks, lines, marks and letters, at both ends of a text too.
    odd = ["".join(x) for letters, most in ((" \na,", 6), (" \t\u3000\x1c\xe9.1'", 3)) for n in range(most) for x in itertools.product(letters, repeat=n)]
    odd += [None, "<|endoftext|>  a", "    if x:\n        y = 1\n\n\n  z \n", "q" * 70 + ",\n" + " ver" * 40 + "  "]
    want = [e.ids for e in Tokenizer.from_file(path).encode_batch([t or "" for t in odd], add_special_tokens=False)]
    for memo in (2, 250_000):
        own = tokens.Encoder(path, "byte", memo)
        assert [np.frombuffer(b, "<u4").tolist() for b in own.encode_column(pa.array(odd))] == want
        assert [np.frombuffer(own.encode_column(pa.array([t], pa.string()))[0], "<u4").tolist() for t in odd[-4:]] == want[-4:]

    class Counted(dict):
        asked = 0

        def get(self, *a):
            Counted.asked += 1
            return super().get(*a)

    own = tokens.Encoder(path, "byte")
    find, cut = own.find, []
    own.memo, own.find = Counted(), lambda text: cut.append(text) or find(text)
    column = pa.array(["One two, three.\ntwo one,  two"] * 500 + ["four, one."])
    assert len(own.encode_column(column)) == 501
    assert cut == [" three.\ntwo"]  # once, and nothing else is cut word for word
    assert Counted.asked <= 16
    own.learn = lambda pieces: {p: b"" for p in pieces if 1 / 0}  # nothing is learned again
    assert own.encode_column(column)[500] == own.encode("four, one.")


def test_token_store(spark, docs, empty):
    path = public_tokenizers.path("word_bpe_49k.json")
    folder, out = token_store.store_tokens(docs, path, "word", 2, file_mb=0.02)
    rows = sorted(out.collect(), key=lambda r: r.start)
    assert len(rows) == docs.count() and [r.doc_id for r in rows] == sorted((r.doc_id for r in rows), key=lambda x: (x is not None, x))
    at = 0
    for r in rows:
        assert r.start == at
        at += r.n_tokens
    own = tokens.Encoder(path, "word")
    got = token_store.fetch(spark, folder, spark.createDataFrame([(3,), (5,)], "doc_id bigint")).collect()
    assert {r.doc_id: r.ids for r in got} == {3: [*np.frombuffer(own.encode(texts()[3]), "<u4").tolist(), 2], 5: [2]}
    assert token_store.store_tokens(empty, path, "word", 2)[1].count() == 0


def test_damaged_frames_are_found():
    import zstandard

    ids = np.arange(9, dtype="<u4").tobytes()
    import xxhash

    frame = zstandard.ZstdCompressor().compress(ids)
    data = token_store.file_bytes([(7, 9, frame, xxhash.xxh64_intdigest(ids) & 0xFFFFFFFF)])
    entry = token_store.seek_table(data)[0]
    assert token_store.read_frame(data, entry) == ids and zstandard.ZstdDecompressor().decompress(data[: entry[2]]) == ids
    with pytest.raises(ValueError):
        token_store.read_frame(data, (*entry[:4], entry[4] ^ 1))
    with pytest.raises(ValueError):
        token_store.seek_table(data[:-1])


def test_differencing_is_near_equal():
    sizes = np.random.default_rng(3).integers(1, 257, 400).tolist()
    windows = packing.deal(sizes, 1024)
    loads = [sum(sizes[k] for k in w) for w in windows]
    assert sorted(k for w in windows for k in w) == list(range(400)) and max(loads) <= 1024 and max(loads) - min(loads) <= 12
    assert len(windows) <= -(-sum(sizes) // 1024) + 1


def test_language(docs, empty, spark):
    rows = [(k, " ".join(np.random.default_rng(k).choice(w, 60)), lang) for k, (lang, w) in enumerate([("aa", ["lorem", "ipsum", "dolor"]), ("bb", ["xyzzy", "quux", "foo"])] * 12)]
    train = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = langid.learn(train)
    got = {r.text: r for r in langid.identify(spark.createDataFrame([("lorem dolor",), ("quux foo",), (None,), ("123 !",), ("",), ("foo " * 20_000,)], "text string"), model).collect()}
    assert got["lorem dolor"].lang_pred == "aa" and got["quux foo"].lang_pred == "bb" and got["foo " * 20_000].lang_pred == "bb"
    assert all(got[t].lang_pred == "und" and got[t].score == 0 for t in (None, "123 !", "")) and all(0 <= r.score <= 1 for r in got.values())
    nothing = langid.learn(empty)
    assert {r.lang_pred for r in langid.identify(docs, nothing).collect()} == {"und"} and langid.identify(empty, model).count() == 0


def test_automaton_parses_like_brute_force(spark):
    rng = np.random.default_rng(8)
    text = "".join(rng.choice(list("abc "), 300))
    model = langid.learn(spark.createDataFrame([(1, text, "q")], "doc_id bigint, text string, lang string"))
    p = langid.Parser(model)
    probe = "".join(rng.choice(list("abcd"), 90))
    s, sizes, _, starts = langid.symbols_of([text], p.table)
    known, (t, n, _, at) = s.tolist(), langid.symbols_of([probe], p.table)
    t, count, k = t.tolist(), 0, 0
    while k < n[0]:
        j = k
        while j < n[0] and any(known[i : i + j + 1 - k] == t[k : j + 1] for i in range(len(known))):
            j += 1
        k, count = max(j, k + 1), count + 1
    assert p.phrases(np.array(t, np.uint8), at, n)[0][0] == count


def test_a_rest_may_end_with_a_bucket(spark):
    rows = spark.range(2 * mixing.BUCKET).select(F.col("id").alias("doc_id"), F.lit(1).cast("long").alias("size"), F.array(F.lit("a")).alias("sources"))
    first = rows.where(F.shiftright(mixing._hash(4) * 2, 40) == 0).count()
    for total in (first - 1, first, first + 1, 2 * mixing.BUCKET, 2 * mixing.BUCKET + first):
        planned, _ = mixing.plan(rows, mixing.cyclic, total)
        assert mixing.copies(rows, planned).agg(F.sum("copies")).first()[0] == total


def test_quotas_and_flow(spark):
    given = spark.createDataFrame([("a", 10, 3.0), ("b", 100, 1.0), ("c", 100, 1.0)], "source string, size bigint, weight double")
    q = {r.source: r.quota for r in mixing.quotas(given, 210.0).collect()}
    assert q["a"] == 30 and abs(sum(q.values()) - 210) < 1e-9 and q["b"] == q["c"]
    flow = mixing.route([(("a", "b"), 10), (("a",), 10)], {"a": 10.0, "b": 10.0})
    assert flow[0].get("b", 0) == 10 and flow[1].get("a", 0) == 10  # rerouted: no second pass


def test_base_spans():
    s = pii.base_spans("mail a.b@c.de or +49 (30) 123-4567, 10.0.0.255 and 4111 1111 1111 1111; 300.1.1.1; x@y")
    assert [k for *_, k in s] == ["email", "phone", "ip", "card"]
    assert pii.base_spans("a" * 300_000 + "1" * 300_000 + "+" * 1000) == [] and pii.base_spans(None) == []


def test_revealing_terms(spark, empty):
    rows = [(k, f"{prose(k, 12)} nickname zorro writes z@mail.com {' '.join(w * 4 for w in 'qwertyuiopasdfgh'[k % 16])} " + "abcdefghijklmnop"[k % 16] * 5) for k in range(8)]
    # 8 mentions in 1008 documents: a term seen with them alone tells log2(1008 / 8) = 7 bits; in 208 documents it would be under 5.
    rows += [(100 + k, f"{prose(k, 10)} ordinary nickname text") for k in range(1000)]
    found = {r.doc_id: r for r in pii.find(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    text = rows[0][1]
    assert f"term:{text.index('zorro')}:{text.index('zorro') + 5}" in found[0].spans and found[0].n_email == 1
    assert all("term" not in found[100 + k].spans for k in range(1000)) and pii.find(empty).count() == 0


def test_copies_of_revealing_documents_count_once(spark):
    # Groups of 2 to 10 copies; unlike 'zorro', 'ferret' is held by 6 more texts, which have copies as well.
    rows = [(k, f"{prose(k, 12)} zorro ferret writes z@mail.com {' '.join(w * 4 for w in 'qwertyuiopas'[k::4])}") for k in range(4)]
    rows += [(100 + k, f"{prose(k, 10)} ordinary {'ferret' if k < 6 else 'weasel'} text") for k in range(1000)] + [(2000, None), (2001, None)]
    copied = [(k + 10_000 * j, t) for k, t in rows for j in range(1 if 106 <= k else 2 * k + 4 if k < 4 else 3)]

    def terms(table):
        docs = spark.createDataFrame(table, "doc_id bigint, text string").repartition(5)
        return {r.term: (r.share, r.bits) for r in pii.revealing(docs, pii.scan(docs)).collect()}

    once = terms(rows)
    assert once["zorro"] == (1.0, np.log2(1004 / 4)) and "ferret" not in once and terms(copied) == once
    found = pii.find(spark.createDataFrame(copied, "doc_id bigint, text string")).where("n_email > 0").collect()
    assert len(found) == 4 + 6 + 8 + 10 and all("term:" in r.spans for r in found)
    # Without a set of the terms in each task, as beyond TERMS_AT_ONCE, texts are counted alike.
    docs, some = spark.createDataFrame(copied, "doc_id bigint, text string"), spark.createDataFrame([("zorro",), ("ferret",)], "term string")
    assert {tuple(r) for r in pii._holding(docs, some, None).collect()} == {("zorro", 4), ("ferret", 10)}


def test_urls(spark, empty):
    rows = [(1, "HTTP://A.Example.NET/en/x?q"), (2, "http://x.example.com/de/1"), (3, "https://foo.org/fr/a#b"), (4, None), (5, "no scheme"), (6, "http://foo.net"), (7, "http://foo.net/"), (8, "http://spam-farm.example.org/en/1"), (9, "://")]
    got = {r.page_id: r for r in urls.judge(spark.createDataFrame(rows, "page_id bigint, url string")).collect()}
    assert (got[1].host, got[1].path, got[1].rule, got[1].verdict) == ("a.example.net", "/en/x", "example.net/en/", "allow")
    assert [got[k].verdict for k in (2, 3, 4, 5, 7, 8)] == ["block", "allow", "allow", "allow", "block", "block"] and got[6].rule is None and got[9].host == ""


def test_transport_streams(docs, spark):
    for n in (0, 1, 64, 157, 162, 163, 164, 170, 346, 347, 16_384, 16_385, 300_000):
        data = np.random.default_rng(n).integers(0, 256, n, dtype=np.uint8).tobytes()
        s = media.demux(media.mux(data))
        assert s.payload == data and s.discontinuities == 0 and s.random_access[0] == 0 and s.times == sorted(s.times)
    stream = media.mux(bytes(10_000))
    assert media.demux(stream[: 188 * 10] + stream[188 * 11 :]).discontinuities == 1
    with pytest.raises(ValueError):
        media.demux(b"x" * 188)
    got = media.probe(spark.createDataFrame([(1, bytearray(stream)), (2, bytearray(b"bad")), (3, None)], "k int, media binary")).orderBy("k").collect()
    assert got[0].payload_bytes == 10_000 and got[1].error and got[2].error == "null"


def test_vectors_that_share_a_direction(spark):
    # 150 isolated pairs at cosine 0.981 among 10,000 vectors of one label at mean cosine 0.9, and one label of a chain.
    rng = np.random.default_rng(5)
    unit = lambda v: v / np.linalg.norm(v, axis=1, keepdims=True)
    x = unit(np.sqrt(0.9) * np.eye(64)[0] + np.sqrt(0.1) * unit(rng.standard_normal((10_000, 64))))
    e = rng.standard_normal((150, 64))
    e = unit(e - (e * x[:150]).sum(axis=1, keepdims=True) * x[:150])
    x = np.concatenate([x, 0.981 * x[:150] + np.sqrt(1 - 0.981**2) * e])
    turn = np.arange(40) * 0.19  # neighbours at cosine 0.982
    rows = [(k, v.tolist(), 0) for k, v in enumerate(x)] + [(20_000 + k, [float(np.cos(t)), float(np.sin(t))], 1) for k, t in enumerate(turn)]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
    got = {r.vec_id: r for r in embeddings.near_duplicates(table).collect()}
    assert len(got) == len(rows) and all(got[10_000 + k].component_id == got[k].component_id for k in range(150))
    links = (x @ x.T >= 0.98).sum(axis=1) - 1
    assert all(got[k].n_links == links[k] for k in range(len(x))) and {got[20_000 + k].component_id for k in range(40)} == {20_000}


def test_lines(spark, docs, empty):
    rows = [(k, "h", f"menu\nown line {k}\n\nfoot ") for k in range(20)] + [(50, "h", None), (51, "h", ""), (52, "h", "menu\nfoot"), (53, None, "menu\nx"), (54, "h", "menu\nown line 0\n\nfoot ")]
    got = {r.doc_id: r for r in lines.drop_boilerplate(spark.createDataFrame(rows, "doc_id bigint, source string, text string"), "source").collect()}
    assert got[3].text == "own line 3\n" and got[3].n_dropped == 2 and got[50].text is None and got[51].text == ""
    assert got[52].text == "menu\nfoot" and got[53].text == "menu\nx" and lines.drop_boilerplate(docs, "source").count() == docs.count()
    assert lines.drop_boilerplate(empty, "source").count() == 0


