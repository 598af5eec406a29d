"""Each operator against brute force, an exact round trip or held-out labels, with null, empty, repeated and clashing input."""

import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from claimweave.llm import bpe, components, decontaminate, licenses, linededup, mpegts, neardedup, quality, rangecoder, simhash, tokenfile, toxicity, urlrules

TEXT = "The quick brown fox jumps over the lazy dog near the quiet river bank today"
ROWS = [(1, TEXT), (2, TEXT), (3, None), (4, ""), (5, "x" * 3000), (None, "under the MIT License, a b"), (7, TEXT + "\n" + TEXT.upper()), (7, "\n \n"), (8, "Été 中文 don't 🙂 <|endoftext|> end")]
SCHEMA = "doc_id long, text string, score double, ids string, media string, n_lines int, _text string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, 0.5, "x", "y", 1, "z") for i, t in ROWS], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 0, 1), (None, 1, 0), (5, None, None)], "doc_id long, quality int, toxic int")


def test_bpe(docs, none):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(bpe.default_path())
    r = random.Random(3)
    parts = ["'s", "'", " the", " ", "  ", "\n", "a", "Z9", "é", "中", "🙂", "!?", "<|endoftext|>", " ", "\U000135c8"]
    texts = ["".join(r.choice(parts) for _ in range(n)) for n in (0, 1, 5, 50, 9000)] + ["a" * 7000, "".join(r.choice("abcde") for _ in range(6000))]
    v = bpe.vocabulary(bpe.default_path())
    ids, first = v.encode(texts)
    assert v.decode(ids, first) == texts
    for k, x in enumerate(texts):
        assert ids[first[k] : first[k + 1]].tolist() == t.encode(x, add_special_tokens=False).ids
    back = bpe.decoded(bpe.encoded(docs)).collect()
    assert sorted((x.doc_id or 0, x.text) for x in back) == sorted((i or 0, x or "") for i, x in ROWS)
    assert bpe.round_trip(none).count() == 0


def test_range_coder():
    r = np.random.default_rng(2)
    for ids in ([], [0], [65535] * 5000, r.integers(0, 50257, 9001), np.tile(r.integers(0, 50257, 50), 200)):
        ids = np.array(ids, np.int32)
        blocks = rangecoder.encode_blocks(ids)
        assert np.array_equal(np.concatenate([np.zeros(0, np.int32), *rangecoder.decode_blocks(blocks)]), ids)
    with pytest.raises(ValueError, match="damaged"):
        rangecoder.decode_blocks([blocks[0][:-1] + bytes([blocks[0][-1] ^ 1])])


def test_token_file(spark, docs, none, tmp_path):
    folder = f"file://{tmp_path}/t"
    manifest = tokenfile.write_tokens(docs, folder)
    got = tokenfile.read_tokens(manifest, folder).orderBy("start").collect()
    assert [x.doc_id for x in got] == sorted((i for i, _ in ROWS), key=lambda i: -1 if i is None else i)
    assert all(x.ids[-1] == 2 and len(x.ids) == x.n_tokens for x in got) and [x.start for x in got] == [sum(y.n_tokens for y in got[:k]) for k in range(len(got))]
    assert tokenfile.read_tokens(tokenfile.write_tokens(none, folder), folder).count() == 0


def test_simhash(spark, docs, none):
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(ROWS) and {x.component_id for x in got if x.doc_id in (1, 2)} == {1} and {x.component_id for x in got if x.doc_id in (3, 4)} == {3}
    assert simhash.near_duplicates(none).count() == 0 and simhash.one_of_each(none).count() == 0
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns and {1, None, 5, 8} <= {x.doc_id for x in kept.collect()} and 2 not in {x.doc_id for x in kept.collect()}


def test_simhash_links_all(spark, monkeypatch):
    monkeypatch.setattr(simhash, "TILE", 40)
    monkeypatch.setattr(simhash, "VISITORS", 50)
    r = random.Random(1)
    seeds = [r.getrandbits(64) for _ in range(20)]
    fps = list({s ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) for s in seeds for _ in range(15)} | {r.getrandbits(64) for _ in range(200)})
    d = spark.createDataFrame([((x - (1 << 64)) if x >> 63 else x,) for x in fps], "fp long")
    roots = {x.node: x.root for x in components.components(simhash.links(d)).collect()}
    par = list(range(len(fps)))

    def find(x):
        while par[x] != x:
            x = par[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                par[find(i)] = find(j)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    groups = {}
    for i, x in enumerate(signed):
        groups.setdefault(find(i), []).append(x)
    want = {x: min(g) for g in groups.values() if len(g) > 1 for x in g}
    assert roots == want


def test_near_copies(spark, none):
    """Planted near copies on both sides of 0.8 against brute force over runs of five words; the stage keeps one of each group."""
    import corpus_pipeline

    r = random.Random(4)
    words = ["".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(3000)]
    texts = []
    for n in (20, 60, 61, 120, 121, 300, 301, 302, 1000, 2000):
        base = [r.choice(words) for _ in range(n)]
        for k in (0, 1, 1, 2, 3, 5, 8, 13):
            copy = list(base)
            for at in r.sample(range(n), k):
                copy[at] = "other" + r.choice(words)
            texts.append(" ".join(copy))
    texts += ["one two", "One  two", "one two three", "", " ", None]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    split = [tuple((x or "").lower().split()) for x in texts]
    sets = [{x[i : i + 5] for i in range(max(1, len(x) - 4))} for x in split]
    par = list(range(len(texts)))

    def find(x):
        while par[x] != x:
            x = par[x]
        return x

    linked = 0
    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                linked += split[i] != split[j]
                a, b = sorted((find(i), find(j)))
                par[b] = a
    assert linked > 100
    want = {i: find(i) for i in range(len(texts))}
    assert {x.doc_id: x.component_id for x in neardedup.near_copies(d).collect()} == want
    kept = corpus_pipeline.one_of_near_copies(spark, d, "")
    assert kept.columns == d.columns and sorted(x.doc_id for x in kept.collect()) == sorted(set(want.values()))
    assert neardedup.near_copies(none).count() == 0


def test_near_copies_by_fingerprint(spark):
    """The stage links fingerprints within two bits as op9 does, though the texts' five-word similarity is lower, and chains over both kinds of links."""
    import corpus_pipeline

    r = random.Random(8)
    words = [f"w{i}" for i in range(400)]
    base = " ".join(r.choice(words) for _ in range(400))
    # Many edits that leave the repeated parts, which decide the majority of each bit.
    texts = []
    for k in (0, 60, 61):
        own = [f"{k}x{i}" for i in range(k)]
        texts.append(" ".join([*["the same three words again"] * 150, *own]))
    texts += [base, base + " end", " ".join(r.choice(words) for _ in range(400))]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    prints = simhash.fingerprints([t.encode() for t in texts])
    runs = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in texts]
    near = {(i, j) for i in range(6) for j in range(i + 1, 6) if int(prints[i] ^ prints[j]).bit_count() <= 2}
    assert (0, 1) in near and len(runs[0] & runs[1]) < 0.8 * len(runs[0] | runs[1])
    assert {x.doc_id: x.component_id for x in neardedup.near_copies(d).collect()} == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3, 5: 5}
    assert sorted(x.doc_id for x in corpus_pipeline.one_of_near_copies(spark, d, "").collect()) == [0, 3, 5]


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, 200), (200, 300), (5, 5)]
    got = {x.node: x.root for x in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 1 for i in range(1, 61)} | {100: 100, 200: 100, 300: 100}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_decontamination(spark, docs, none, monkeypatch):
    items = spark.createDataFrame([(1, TEXT), (2, None), (3, ""), (4, "quite other words that stand nowhere at all here"), (None, TEXT), (6, "under the mit")], "item_id long, text string")
    for most in (10**6, 1):
        monkeypatch.setattr(decontaminate, "BROADCAST", most)
        got = {(x.doc_id, x.item_id) for x in decontaminate.contained(docs, items).collect()}
        assert got == {(1, 1), (2, 1), (7, 1)}
    kept = decontaminate.clean(docs, items)
    assert kept.columns == docs.columns and {x.doc_id for x in kept.collect()} == {3, 4, 5, None, 7, 8}
    assert decontaminate.contained(none, items).count() == 0 and decontaminate.contained(docs, items.where("false")).count() == 0


def test_short_items(spark, monkeypatch, tmp_path):
    rows = [(1, "code under the MIT License here and more words"), (2, "under the"), (3, "the MIT"), (4, "a mit"), (5, "under a the mit license for all"), (6, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    items = spark.createDataFrame([(1, "under the mit"), (2, "license"), (3, "mit license for all"), (4, "The MIT")], "item_id long, text string")
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for most in (10**6, 1):
        monkeypatch.setattr(decontaminate, "BROADCAST", most)
        got = {(x.doc_id, x.item_id) for x in decontaminate.op2_decontamination(spark, str(tmp_path)).collect()}
        assert got == {(1, 1), (1, 2), (1, 4), (3, 4), (5, 2), (5, 3), (5, 4)}
    assert {x.doc_id for x in decontaminate.clean(docs, items, short=True).collect()} == {2, 4, 6}


def test_items_of_one_id(spark, monkeypatch):
    r = random.Random(8)
    a, b = (" ".join(f"{k}{r.randrange(10**6)}" for _ in range(20)) for k in "ab")
    items = spark.createDataFrame([(1, a), (1, b), (1, a), (2, a + " " + b)], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"x y {a} z"), (2, f"{b}"), (3, a[:60]), (4, f"{a} {b}")], "doc_id long, text string")
    for most in (10**6, 1):
        monkeypatch.setattr(decontaminate, "BROADCAST", most)
        got = sorted((x.doc_id, x.item_id, x.containment) for x in decontaminate.contained(docs, items).collect())
        assert got == [(1, 1, 1.0), (2, 1, 1.0), (4, 1, 1.0), (4, 2, 1.0)]
    assert [x.doc_id for x in decontaminate.clean(docs, items).collect()] == [3]


def test_line_dedup(docs, none):
    got = {(x.doc_id, x.text) for x in linededup.deduplicated(docs).collect()}
    assert (1, TEXT) in got and (2, "") in got and (3, None) in got and (4, "") in got and (7, "") in got and (7, "\n \n") in got and (5, "x" * 3000) in got
    assert linededup.deduplicated(none).count() == 0


def test_fuzzy_lines(spark, monkeypatch):
    monkeypatch.setattr(linededup, "TILE", 7)
    r = random.Random(6)
    words = ["".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(400)]
    base = " ".join(r.choice(words) for _ in range(60))
    near = [base.replace(base.split()[k], "changed", 1) for k in range(30)]
    other = [" ".join(r.choice(words) for _ in range(60)) for _ in range(30)]
    d = spark.createDataFrame(list(enumerate([base, *near, *other])), "doc_id long, text string")
    got = {x.doc_id: x.text for x in linededup.deduplicated(d).collect()}
    assert got[0] == base and all(got[i] == "" for i in range(1, 31)) and all(got[i] for i in range(31, 61))


def test_one_changed_word(spark):
    """Lines of 60 to 120 characters, each with a copy that has one other word, against brute force over runs of five characters."""
    r = random.Random(11)
    word = lambda n: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    lines, copies = [], []
    for n in range(60, 121, 2):
        line = ""
        while len(line) < n:
            line += word(r.randint(3, 7)) + " "
        words = line[:n].split()
        k = r.randrange(1, len(words) - 1)
        lines.append(" ".join(words))
        copies.append(" ".join([*words[:k], word(len(words[k])), *words[k + 1 :]]))
    d = spark.createDataFrame(list(enumerate(lines + copies)), "doc_id long, text string")
    got = {x.doc_id for x in linededup.deduplicated(d).where("text = ''").collect()}
    sets = [{x[i : i + 5] for i in range(len(x) - 4)} for x in lines + copies]
    n = len(lines)
    assert got == {n + i for i in range(n) if len(sets[i] & sets[n + i]) >= 0.8 * len(sets[i] | sets[n + i])}
    assert len(got) > 15


def test_quality(docs, none, labels):
    good = [" ".join(random.Random(i).choice(["river", "stone", "walks", "under", "light", "green"]) for _ in range(60)).encode() for i in range(60)]
    bad = [(b"BUY!!! $$$ NOW### " * (10 + i)) for i in range(60)]
    n = quality.Network().fit([*good[:40], *bad[:40]], [1] * 40 + [0] * 40, 0.5)
    assert (n.scores(good[40:]) > 0.5).all() and (n.scores(bad[40:]) < 0.5).all()
    out = quality.scored(docs, quality.train(docs, labels))
    assert out.count() == len(ROWS) and out.where("score between 0 and 1").count() == len(ROWS)
    assert quality.good(docs, labels.where("false")).columns == docs.columns and quality.scored(none, n).count() == 0


def test_toxicity(docs, none, labels):
    r = random.Random(2)
    words = [f"w{i}x" for i in range(200)]
    sentences = [[" ".join(r.choice(words) for _ in range(8)) for _ in range(5)] for _ in range(200)]
    y = [i % 2 for i in range(200)]
    for s, k in zip(sentences, y, strict=True):
        if k:
            s[2] += " vileword"
    texts = [". ".join(s).encode() for s in sentences]
    m = toxicity.Model.fit(texts[:150], y[:150], 0.5)
    s = toxicity.Sentences(texts[150:])
    assert ((m.scores(s, 50) >= 0.5) == np.array(y[150:])).all()
    worst = int(np.argmax(m.sentence_scores(s)))
    a, b = s.span(worst)
    assert b"vileword" in texts[150 + int(s.text[worst])][a:b]
    got = {(x.doc_id, x.score) for x in toxicity.scored(docs, toxicity.train(docs, labels)).collect()}
    assert len(got) >= 7 and all(0 <= p <= 1 for _, p in got) and toxicity.scored(none, m).count() == 0


def test_mpegts(docs, none):
    for n in (64, 128, 8192, 8256, 30016):
        p = bytes(i * 7 % 251 for i in range(n))
        s = mpegts.parsed(mpegts.muxed(p, n - 1))
        assert s.payload == p and s.unpadded == n - 1 and s.counter_errors == 0 and s.at(10**9) == (n - 1) // mpegts.UNIT * mpegts.UNIT
    m = mpegts.muxed(bytes(20000 // 64 * 64), 5)
    assert mpegts.parsed(m[: 188 * 5] + m[188 * 6 :][: 188 * 0] + m[188 * 5 :]).counter_errors == 0
    got = mpegts.media_features(mpegts.with_media(docs)).collect()
    assert {(x.n_bytes, x.payload_bytes) for x in got if x.doc_id in (3, 4)} == {(0, 64)} and mpegts.with_media(none).count() == 0


def test_urls(spark, labels):
    rows = [(1, "http://A.example.net/en/1"), (2, "http://a.example.net/x/1"), (3, None), (4, "no scheme"), (5, "https://b.org/fr/?q"), (6, "http://example.com/de/a#x"), (7, "http://h.test/a/b/c/d/e/f/g/h/9"), (7, "http://h.test")]
    d = spark.createDataFrame(rows, "page_id long, url string")
    got = {(x.page_id, x.host, x.path): (x.rule, x.verdict) for x in urlrules.judged(d, labels).collect()}
    assert got[1, "a.example.net", "/en/1"] == ("example.net/en/", "allow") and got[2, "a.example.net", "/x/1"] == ("net/", "block") and got[5, "b.org", "/fr/"] == ("org/fr/", "allow")
    assert got[6, "example.com", "/de/a"] == ("example.com/de/", "block") and got[3, "", ""][0] is None and got[4, "", ""][0] is None and len(got) == len(rows)
    assert urlrules.judged(d.where("false"), labels).count() == 0 and urlrules.judged(d, labels.where("false")).where("verdict = 'block'").count() == 2


def test_licenses(docs, none):
    assert len(licenses.rules()) > 300
    text = "code under the mit license and under the mit license see cc by nc sa 4 0 also gnu lesser general public license v3"
    assert [p for p, _ in licenses.base_places(text)] == [1, 6, 11]
    labels = {d.label for d in licenses.detect(text, set(text.split()))}
    assert {"mit", "cc-by-nc-sa", "lgpl-3"} <= labels and "gpl" not in labels and "cc-by" not in labels
    got = {x.doc_id: x for x in licenses.scanned(docs).collect()}
    assert got[None].n_words == 6 and got[None].base[0].label == "mit" and got[3].n_words == 0 and licenses.scanned(none).count() == 0
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ROWS[-1][1].lower())
    assert got[8].n_words == len(words)


def test_license_bodies(spark):
    """Bodies that do not name their license."""
    texts = {
        "zlib": "The origin of this software must not be misrepresented; you must not claim that you wrote the original software.",
        "boost": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\")",
        "apache-2": "Software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND",
        "gpl-3": "if you distribute copies of such a program, whether gratis or for a fee, you must pass on to the recipients the same freedoms that you received.",
        "bsd-3-clause": "Neither the name of the copyright holder nor the names of its\n * contributors may be used to endorse or promote products derived from this software",
        "agpl-3": "your modified version must prominently offer all users interacting with it remotely through a computer network (if your version supports such interaction)",
        "sil-ofl": "Neither the Font Software nor any of its individual components, in Original or Modified Versions, may be sold by itself.",
    }
    d = spark.createDataFrame(list(enumerate([*texts.values(), "the origin of this software is a river, and you may use the material"])), "doc_id long, text string")
    got = {x.doc_id: {y.label for y in x.detections} for x in licenses.scanned(d).collect()}
    assert all(label in got[i] for i, label in enumerate(texts)) and not got[len(texts)]


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    d = spark.createDataFrame([(i, f"{TEXT} number {i} " + " ".join(f"word{i}x{k}" for k in range(30)), "en", "s", 10) for i in range(12)], "doc_id long, text string, lang string, source string, n_chars long")
    d.unionByName(d).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, " ".join(f"word3x{k}" for k in range(20)))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert {x.doc_id for x in out.collect()} == set(range(12)) - {3} and out.select(F.max("n_tokens")).first()[0] > 50


def test_line_shingles():
    texts = ["Ab\t c\n\nabcdefg abcdefg\r\n  é\U0001f600\n", "", " \n", "größer als größer\nabc", "x" * 70000]
    lines = linededup.Lines([x.encode() for x in texts])
    want = [(i, k, " ".join(x.split())) for i, t in enumerate(texts) for k, x in enumerate(t.split("\n")) if x.split()]
    assert [(i, k, x.decode()) for i, k, x in zip(lines.text.tolist(), lines.position.tolist(), lines.norms, strict=True)] == want
    h, at = lines.shingles()
    got = [set(h[a:b].tolist()) for a, b in zip(at, at[1:], strict=False)]
    runs = [{x[i : i + 5] for i in range(max(1, len(x) - 4))} for _, _, x in want]
    assert [[len(a & b) for a in got] for b in got] == [[len(a & b) for a in runs] for b in runs]
    # A shingle of ASCII characters is its own code, so that no two of them are taken for one.
    for codes, shingles in zip(got, runs, strict=True):
        assert {x for x in codes if x < 1 << 39} == {int.from_bytes(x.encode(), "little") for x in shingles if x.isascii()}


def test_met_bands():
    rng = np.random.default_rng(5)
    lines = rng.integers(-(1 << 63), 1 << 63, 3000)
    bands = rng.integers(-(1 << 63), 1 << 63, (3000, 12))
    bands[:, 3] = np.repeat(bands[:1000, 3], 3)
    bands[:2500, 7] = 11
    lines[2900:], bands[2900:] = lines[2800:2900], bands[2800:2900]
    batch = pa.RecordBatch.from_arrays([pa.array(lines), linededup.blobs(bands, np.arange(0, 36001, 12))], ["line", "bands"])
    stand = {}
    for line, own in zip(lines.tolist(), bands.tolist(), strict=True):
        for x in own:
            stand.setdefault(x, set()).add(line)
    for crowd, crowded in ((100, {11}), (3000, set()), (1, {x for x, own in stand.items() if len(own) > 1})):
        rows = pa.Table.from_batches(linededup._dealt(iter([batch.slice(0, 1702), batch.slice(1702), batch.slice(0, 0)]), 12, 7, crowd))
        assert len(rows) <= 28 and set(rows.column("bucket").to_pylist()) == set(range(7))
        found = pa.concat_tables([linededup._met_in_bucket(rows.filter(pc.equal(rows.column("bucket"), k))) for k in range(7)]).to_pylist()
        full = {x["band"] for x in found if x["line"] is None}
        assert full <= crowded and (crowd == 1 or full == crowded)
        got = sorted((x["band"], x["line"]) for x in found if x["line"] is not None)
        assert got == sorted((x, line) for x, own in stand.items() if len(own) > 1 and x not in full for line in own)


def test_crowded_bands(spark, monkeypatch):
    base = TEXT + " and home again"
    rows = [(k, f"{base} {'abcdefgh'[k % 8]}{k}\nline {k * k * 7919} of its own {k}") for k in range(60)] + [(99, "alone")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = []
    for crowd in (100, 2):
        monkeypatch.setattr(linededup, "CROWD", crowd)
        got.append({(x.doc_id, x.text) for x in linededup.deduplicated(d).collect()})
    assert got[0] == got[1] and sum(base in t for _, t in got[0]) == 1


def test_simhash_memory():
    """A tile of one large group of near copies takes little memory."""
    rng = np.random.default_rng(3)
    near = rng.integers(0, 1 << 63, 1, dtype=np.uint64) ^ (np.uint64(1) << rng.integers(0, 64, 8192, dtype=np.uint64))
    far = rng.integers(0, 1 << 63, 2, dtype=np.uint64)
    tracemalloc.start()
    a, b = simhash._links_in_tile(np.append(near[:2000], far), near[2000:], 2)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(a) == 8191 and len(set(b.tolist())) == 1 and not set(far.tolist()) & {*a.tolist(), *b.tolist()}
    assert most < 50e6
