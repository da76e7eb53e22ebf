"""The ten operators against brute force and on edge cases: nulls, empty and long texts, ties, repeats, empty tables."""

import base64
import collections
import hashlib
import itertools
import random
import re
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from claimsieve.llm import chat, decontaminate, graph, html_crf, jaccard, mixing, pairwise, quality_rules, textstats, token_pack, toxicity, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long, start string"


def rows_of(texts):
    return [(i, t, "en", "s", 0, "clash") for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.collect()}


# 1 toxicity


def test_chain_uses_earlier_categories_and_finds_words(spark):
    rng = random.Random(3)
    common = [f"word{k}" for k in range(40)]
    rows, labels = [], []
    for i in range(600):
        bad = i % 5 == 0
        words = rng.choices(common, k=30) + (["idiot"] if bad else []) + (["spam"] if i % 10 == 0 else [])
        rows.append((i, " ".join(words), "en", "s", 0, "x"))
        labels.append((i, int(i % 10 == 0), int(bad)))
    docs = spark.createDataFrame(rows + [(900, None, "en", "s", 0, "x"), (901, "", "en", "s", 0, "x"), (902, "You IDIOT!", None, None, None, None)], DOCS)
    got = {r["doc_id"]: r for r in toxicity.score_toxicity(docs, spark.createDataFrame(labels, "doc_id long, spam int, toxic int"), ["spam", "toxic"]).collect()}
    assert len(got) == 603 and all(got[i]["is_toxic"] == (i % 5 == 0) for i in range(600))
    assert got[902]["is_toxic"] and not got[900]["is_toxic"] and got[900]["toxicity"] == got[901]["toxicity"]


def test_chain_without_labels(spark):
    docs = spark.createDataFrame(rows_of(["a b", None]), DOCS)
    out = toxicity.score_toxicity(docs, spark.createDataFrame([], "doc_id long, toxic int"), ["toxic"]).collect()
    assert len(out) == 2 and not any(r["is_toxic"] for r in out)


def test_later_models_learn_from_out_of_fold_predictions():
    n = 300
    y = np.stack([np.arange(n) % 2, np.arange(n) % 2], axis=1)
    made = toxicity.train_chain(np.arange(n), y[:, 0], y, np.arange(n) // 2 % 3, np.array([5, 9], dtype=np.uint64), ["a", "b"])
    assert made.models[1].dense.shape == (1,) and made.models[1].dense[0] > 0


# 2 token ids


@pytest.mark.parametrize("width", [1, 5, 11, 16, 17, 20, 31, 32])
def test_pack_round_trip(width):
    ids = np.random.default_rng(width).integers(0, 2**width, 1003).astype(np.uint32)
    assert (token_pack.unpack(token_pack.pack(ids, width), width, len(ids)) == ids).all()


def test_packed_ids_equal_plain_encoding(spark, texts):
    odd = [None, "", "  a  b", "it's 'sub' we'll  they've!'s \n's 's", "x\n\n y\t z  q", "日本語 text 123abc", "😀 smile's", "a\x00b", "''s", "don't'll've", "\n", "<|endoftext|>", "a <|endoftext|> b", "<|endoftext|", "w " * 30000]
    rows = rows_of([*odd, *list(texts.values())[:40]])
    path = public_tokenizers.path("byte_bpe_50k.json")
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    got = token_pack.pack_documents(spark.createDataFrame(rows, DOCS).repartition(5), path, 50_257).orderBy("doc_id").collect()
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    untouched, start = Tokenizer.from_file(path), 0
    assert len(got) == len(rows)
    for r, row in zip(got, rows):
        ids = np.append(untouched.encode(row[1] or "", add_special_tokens=False).ids, 0).astype("<u4")
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (row[0], start, len(ids), zlib.crc32(ids.tobytes())), row[1]
        start += len(ids)


def test_words_of_equal_hash_are_told_apart(texts, monkeypatch):
    path = public_tokenizers.path("byte_bpe_50k.json")
    keys = token_pack.word_keys

    def crowded(chars, start, stop):
        key, second = keys(chars, start, stop)
        return key % np.uint64(97), second

    monkeypatch.setattr(token_pack, "word_keys", crowded)
    untouched, encoder = Tokenizer.from_file(path), token_pack.WordEncoder(path)
    for part in (["a b", "", "longer words than before", "a"], ["b a a", "x"], list(texts.values())[:30], ["a"]):
        ids, counts = encoder.encode(part, 0)
        assert [p.tolist() for p in np.split(ids, np.cumsum(counts)[:-1])] == [[*untouched.encode(t, add_special_tokens=False).ids, 0] for t in part]


def test_random_access(tmp_path):
    ids = np.random.default_rng(1).integers(0, 50_000, 10_000).astype(np.uint32)
    writer = token_pack.PackWriter(f"{tmp_path}/a.idpk", 17, block=64)
    writer.add(ids, np.array([100, 0, 9_000, 900]))
    writer.close()
    reader = token_pack.PackReader(f"{tmp_path}/a.idpk")
    assert (reader.document(2) == ids[100:9100]).all() and len(reader.document(1)) == 0 and (reader.ids(9_950, 10_000) == ids[9_950:]).all()


def test_empty_table_packs_nothing(spark):
    assert token_pack.pack_documents(spark.createDataFrame([], DOCS), public_tokenizers.path("byte_bpe_50k.json"), 50_257).count() == 0


# 3 chat


def test_chat_escapes_and_masks(spark):
    texts = ["\\### Assistant: </turn> ok", "<|end|>\n<|turn assistant|>\n", "\\\\l\\", "\\n<\\\\<", None, "", "<|image 1|>"]
    rows = [(c, t, r, x, "clash") for c in (1, None) for t, (r, x) in enumerate(itertools.product(["user", "assistant", None, "a<\nb\\"], texts))]
    out = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string"))
    back = out.select("conv_id", chat.parse(F.col("formatted")).alias("t"), chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"), "formatted", "loss_spans").collect()
    assert len(back) == 2
    for r in back:
        mine = [(x[2] or "", x[3] or "") for x in rows if x[0] == r["conv_id"]]
        assert [(t["role"], t["body"]) for t in r["t"]] == mine
        assert r["loss"] == "".join(x for role, x in mine if role == "assistant")


def test_chat_parts(spark):
    kind = "conv_id long, turn long, role string, parts array<struct<type:string,text:string,ref:string,amount:double>>"
    rows = [
        (1, 0, "user", [("text", "see ", None, None), ("image", None, "a.png", 1000.0), ("audio", None, "b.wav", 2.0)]),
        (1, 1, "assistant", [("document", None, "c.pdf", 3.0), ("video", None, "d", 1.0), ("text", "<ok", None, None)]),
        (2, 0, "user", None),
    ]
    got = {r["conv_id"]: r for r in chat.format_conversations(spark.createDataFrame(rows, kind), F.col("parts")).collect()}
    assert got[1]["formatted"] == "<|turn user|>\nsee <|image 1|><|audio 2|><|end|>\n<|turn assistant|>\n<|document 3|><|attachment 4|>\\lok<|end|>\n"
    assert [(a["number"], a["type"], a["ref"], a["tokens"]) for a in got[1]["attachments"]] == [(1, "image", "a.png", 2), (2, "audio", "b.wav", 50), (3, "document", "c.pdf", 1536), (4, "video", "d", 0)]
    assert got[1]["attachment_tokens"] == 1588 and got[2]["formatted"] == "<|turn user|>\n<|end|>\n" and got[2]["attachments"] == []


def test_chat_stays_in_the_jvm(spark, sf_dir):
    plan = chat.format_conversations(spark.read.parquet(f"{sf_dir}/conversations.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


# 4 pages


def test_blocks_and_references():
    html = "<html><head><title>T</title><script>var a='</p>';</script></head><body><!-- x --><p>a &amp; b<br>c &lt;d&gt; <b>e</b><p>f</body>"
    assert [b.text for b in html_crf.blocks_of(html)] == ["T", "a & b c <d> e", "f"]
    assert html_crf.blocks_of("") == [] and [b.text for b in html_crf.blocks_of("plain &am text")] == ["plain &am text"]


def test_field_on_held_out_layouts_and_pages(spark, sf_dir):
    field = html_crf.train_field(html_crf.training_pages([]))
    rng, right, total = random.Random(77), 0, 0
    for _ in range(150):
        html, truth = html_crf.layout_page(rng, ["The quick fox jumps over the lazy dog again.", "It rained.", "Another day went by, so they waited for news."])
        got = field.decode(html_crf.features_of(html_crf.blocks_of(html)))
        right += sum(a == y for a, (_, y) in zip(got, truth))
        total += len(truth)
    assert right / total > 0.97
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    extra = spark.createDataFrame([(-1, None, None), (-2, "u", "")], "page_id long, url string, html string")
    got = {r["page_id"]: r for r in html_crf.extract_pages(pages.unionByName(extra), html_crf.fit_field(pages)).collect()}
    assert got[-1]["text"] == "" and got[-2]["n_chars"] == 0
    want = {}
    for r in pages.collect():
        inner = r["html"][r["html"].index("<article>") + 9 : r["html"].index("</article>")]
        parts = [" ".join(html_crf.unescape(re.sub("<[^>]*>", " ", x)).split()) for x in re.split("</?(?:p|h1)>", inner)]
        want[r["page_id"]] = "\n".join(x for x in parts if x)
    assert sum(got[k]["text"] == v for k, v in want.items()) >= 0.99 * len(want)


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(4)
    field = html_crf.Field({str(k): k for k in range(6)}, rng.normal(size=(6, 2)), rng.normal(size=(2, 2)))
    rows = [[str(x) for x in rng.choice(6, 2, replace=False)] for _ in range(8)]
    s = field.scores(rows)
    best = max(itertools.product((0, 1), repeat=8), key=lambda y: sum(s[i, a] for i, a in enumerate(y)) + sum(field.moves[a, b] for a, b in zip(y, y[1:])))
    assert tuple(field.decode(rows)) == best


@pytest.mark.parametrize("part", ["<a ", '<a "', "<div>x", "<div>", '<a "" ', "<!", "a<", "<a '\" ", "</a "])
def test_malformed_pages_take_time_in_proportion(part):
    def seconds(n):
        start = time.perf_counter()
        html_crf.blocks_of(part * n)
        return time.perf_counter() - start

    small = max(min(seconds(10_000) for _ in range(3)), 0.005)
    assert min(seconds(40_000) for _ in range(2)) < 10 * small


def test_marks_inside_words_are_no_blanks():
    html = "<p>super<wbr>cali a<img src='x>y'>b c<br>d</p><p class=\"a>b\">e <a href='\"'>f</a> 1 < 2"
    assert [b.text for b in html_crf.blocks_of(html)] == ["supercali ab c d", "e f 1 < 2"]


# 5 decontamination

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return _WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute_hits(doc, items, window=10):
    w, hit, found = words(doc), set(), set()
    for item, text in items:
        v = words(text)
        size = min(window, len(v))
        grams = {tuple(v[i : i + size]) for i in range(len(v) - size + 1)} if v else set()
        for i in range(len(w) - size + 1):
            if grams and tuple(w[i : i + size]) in grams:
                hit |= set(range(i, i + size))
                found.add(item)
    return len(w), len(hit), found


@pytest.mark.parametrize("block_words", [decontaminate.BLOCK_WORDS, 40])
def test_phrases_against_brute_force(spark, block_words, monkeypatch):
    rng = random.Random(8)
    vocabulary = ["the", "of", "É", "ab", "zz9", "Word", "q"]
    items = [(k, " ".join(rng.choices(vocabulary, k=rng.choice([1, 4, 10, 11, 14])))) for k in range(12)] + [(50, None), (51, "..."), (7, "repeated item id of another text")]
    texts = [" ".join(rng.choices(vocabulary, k=rng.choice([0, 3, 200, 900]))) for _ in range(40)] + [None, "", "the", items[3][1], " x ".join(t or "" for _, t in items)]
    monkeypatch.setattr(decontaminate, "SEGMENT_BYTES", 3000)
    index = decontaminate.build_index(spark.createDataFrame(rows_of(texts), DOCS), segment_bytes=3000)
    found = decontaminate.search(index, spark.createDataFrame(items, "item_id long, text string"), block_words=block_words)
    got = {r["doc_id"]: r for r in found.withColumn("n_hit", decontaminate.covered(F.col("spans"))).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        n, hit, names = brute_hits(t, items)
        assert (got[i]["n_words"], got[i]["n_hit"], set(got[i]["items"])) == (n, hit, names), i


def test_proximity_and_empty(spark):
    docs = spark.createDataFrame(rows_of(["rare x x common", "rare x x x x x common", "common rare"]), DOCS)
    items = spark.createDataFrame([(1, "rare common")], "item_id long, text string")
    got = {r["doc_id"]: r["items"] for r in decontaminate.search(decontaminate.build_index(docs), items, slop=3).collect()}
    assert got == {0: [1], 1: [], 2: [1]}
    assert decontaminate.contamination(docs.limit(0), items).count() == 0
    assert decontaminate.contamination(docs, items.limit(0)).filter("contaminated").count() == 0


def test_items_that_share_a_text_are_searched_once(spark):
    text = "one two three four five six seven eight nine ten eleven"
    items = [(k, text) for k in range(3000)] + [(None, text), (None, text), (1, "other words"), (5000, text.upper())]
    docs = spark.createDataFrame(rows_of(["x " + text, "other words", "none", None]), DOCS)
    index, table = decontaminate.build_index(docs), spark.createDataFrame(items, "item_id long, text string")
    for block_words in (decontaminate.BLOCK_WORDS, 13):
        got = {r["doc_id"]: r["items"] for r in decontaminate.search(index, table, block_words=block_words).collect()}
        assert len(got[0]) == 3002 and set(got[0]) == {*range(3000), None, 5000}
        assert got[1] == [1] and got[2] == [] and got[3] == []


def test_clean_goes_by_row(spark):
    hit = "one two three four five six seven eight nine ten"
    rows = [(None, hit, "en", "s", 0, "x"), (None, "clean", "en", "s", 0, "x"), (5, hit, "en", "s", 0, "x"), (5, "clean", "en", "s", 0, "x"), (5, None, "en", "s", 0, "x"), (6, "clean", "en", "s", 0, "x"), (6, "clean", "en", "s", 0, "x")]
    kept = decontaminate.clean(spark.createDataFrame(rows, DOCS), spark.createDataFrame([(1, hit)], "item_id long, text string"))
    assert sorted((str(r["doc_id"]), str(r["text"])) for r in kept.collect()) == [("5", "None"), ("5", "clean"), ("6", "clean"), ("6", "clean"), ("None", "clean")]


# 6 and 8 quality

_SPACED = re.compile(r"[^\x20\x09-\x0D]+")


def brute_base(text):
    w = _SPACED.findall(text or "")
    lines = [x for x in (text or "").split("\n") if _SPACED.search(x)]
    grams = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    hit = {i + k for i in range(len(w) - 7) if grams[tuple(w[i : i + 8])] > 1 for k in range(8)}
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit))


def test_base_counts(spark, texts):
    odd = [None, "", " \n\t", "a\n a\na\n\n", "é é x [#] <|>", "x y " * 9, ("one two three four five six seven eight nine\n" * 3), "z" * 100_000]
    rows = rows_of(odd + list(texts.values())[:150])
    got = {r["doc_id"]: tuple(r[c] for c in textstats.BASE) for r in textstats.text_stats(spark.createDataFrame(rows, DOCS), ["doc_id"]).collect()}
    assert got == {r[0]: brute_base(r[1]) for r in rows}


def test_decision_list_learns_and_keeps_good(spark, sf_dir, docs):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    judged, rules = quality_rules.judge(docs, labels)
    seen = judged.join(labels, "doc_id").collect()
    assert judged.count() == docs.count() and len(seen) > 20
    assert all(r["kept"] for r in seen if r["quality"] == 1 and not r["base_failed"])
    nothing, empty = quality_rules.judge(docs, labels.limit(0))
    assert not empty.rules and nothing.filter("kept = base_failed").count() == 0


def test_rules_are_ordered_conjunctions():
    rng = np.random.default_rng(2)
    x = rng.random((900, 2))
    bad = (x[:, 0] > 0.8) | ((x[:, 0] < 0.3) & (x[:, 1] > 0.6))
    rules = quality_rules.learn_list(x, ~bad, ["a", "b"])
    hit = np.zeros(len(x), dtype=bool)
    for rule in rules.rules:
        hit |= quality_rules._mask(rule, x, ["a", "b"])
    assert (hit == bad).mean() > 0.97 and any(len(r) > 1 for r in rules.rules)


def test_ranking_held_out(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    extra = spark.createDataFrame([(-5, None, "en", "s", 0), (-6, "", "en", "s", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    scored, _ = pairwise.rank_documents(docs.unionByName(extra), labels)
    rows = scored.join(labels, "doc_id").filter("held_out").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    assert np.mean([r["predicted"] == r["quality"] for r in rows]) > 0.95
    assert scored.filter("doc_id < 0 and score between 0 and 1").count() == 2
    assert pairwise.rank_documents(docs, labels.limit(0))[0].filter("score = 0.5").count() == docs.count()


def test_sample_has_one_row_of_each_id(spark):
    rows = [(1, "one " * 30, "en", "s", 0, "x")] * 5000 + [(2, f"two {i} " * 30, "en", "s", 0, "x") for i in range(50)]
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1)], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame(rows, DOCS)
    x, good, _ = quality_rules.labelled_sample(docs, labels, "quality", rows=2)
    assert x.shape[0] == 2 and sorted(good.tolist()) == [False, True]
    judged = quality_rules.judge(docs, labels)[0]
    assert judged.count() == 5050 and pairwise.rank_documents(docs, labels)[0].count() == 5050
    assert toxicity.score_toxicity(docs, labels, ["toxic"]).count() == 5050


def test_verdict_equals_the_printed_list(spark, docs, sf_dir):
    """Every row by a plain evaluation of the list's own text."""
    judged, rules = quality_rules.judge(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    lines = str(rules).splitlines()
    assert lines[-1] == "else keep"
    named = textstats.ratios()
    wide = {r["doc_id"]: r.asDict() for r in textstats.text_stats(docs, ["doc_id"]).select("doc_id", *[c.alias(k) for k, c in named.items()]).collect()}

    def keeps(row):
        for line, rule in zip(lines, rules.rules):
            tests = line.removeprefix("reject if ").split(" and ")
            assert len(tests) == len(rule)
            if all(row[t.name] > t.threshold if " > " in text else row[t.name] <= t.threshold for t, text in zip(rule, tests)):
                return False
        return True

    for r in judged.collect():
        assert r["kept"] == (not r["base_failed"] and keeps(wide[r["doc_id"]]))


def test_held_out_recall_on_labels(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    known = labels.select("doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic")
    side = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    scored = toxicity.predict_chain(docs.join(known.filter(side), "doc_id", "left_semi"), toxicity.fit_chain(docs, known.filter(~side), ["low_quality", "toxic"]))
    rows = scored.join(known, "doc_id").collect()
    toxic = [r for r in rows if r["toxic"] == 1]
    recall = sum(r["is_toxic"] for r in toxic) / len(toxic)
    precision = sum(r["is_toxic"] for r in toxic) / max(1, sum(r["is_toxic"] for r in rows))
    print(f"held-out toxic recall {recall:.3f}, precision {precision:.3f}, {len(toxic)} of {len(rows)}")
    assert recall > 0.85 and precision > 0.9


# 7 Jaccard join


def brute_groups(rows, k, percent):
    sets = {}
    for i, t in rows:
        w = _SPACED.findall((t or "").lower() if (t or "").isascii() else "".join(c.lower() if "A" <= c <= "Z" else c for c in t))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("small, bits", [(16, 1 << 25), (2, 8)])
def test_groups_against_brute_force(spark, small, bits, monkeypatch):
    monkeypatch.setattr(jaccard, "SMALL_BUCKET", small)
    monkeypatch.setattr(jaccard, "FILTER_BITS", bits)
    rng = random.Random(small)
    base = [[f"w{rng.randrange(400)}" for _ in range(60)] for _ in range(3)]
    texts = [None, "", " ", "one two", "ONE TWO", "a b c d", "x " * 50]
    for b in base:
        for _ in range(45):
            w = list(b)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                w[rng.randrange(60)] = f"e{rng.randrange(10**6)}"
            texts.append(" ".join(w))
    rows = rows_of(texts)
    rng.shuffle(rows)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.similar_groups(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == brute_groups([(r[0], r[1]) for r in rows], 4, 85)


@pytest.mark.parametrize("linear, block", [(2, 3), (8, 1024)])
def test_unlike_documents_of_shared_passages(spark, linear, block, monkeypatch):
    monkeypatch.setattr(jaccard, "SMALL_BUCKET", 2)
    monkeypatch.setattr(jaccard, "LINEAR", linear)
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rng = random.Random(7)
    passages = [" ".join(f"p{i}w{j}" for j in range(rng.randrange(6, 30))) for i in range(14)]
    texts = [" ".join(passages[i] for i in sorted(rng.sample(range(14), rng.randrange(1, 12)))) for _ in range(160)]
    texts += [t + f" extra{i} words here" for i, t in enumerate(texts[::4])]
    rows = rows_of(texts)
    rng.shuffle(rows)
    for percent in (85, 100):
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.similar_groups(spark.createDataFrame(rows, DOCS), 4, percent).collect()}
        assert got == brute_groups([(r[0], r[1]) for r in rows], 4, percent)


def test_turns_read_written_rows_of_open_buckets(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "SMALL_BUCKET", 2)
    monkeypatch.setattr(jaccard, "LINEAR", 2)
    rng = random.Random(7)
    passages = [" ".join(f"p{i}w{j}" for j in range(rng.randrange(6, 30))) for i in range(14)]
    rows = rows_of([" ".join(passages[i] for i in sorted(rng.sample(range(14), rng.randrange(1, 12)))) for _ in range(160)])
    turns, meet = [], jaccard._meet

    def seen(placed, *rest):
        open_now = {r[0] for r in placed.filter("waits").select("token").collect()}
        turns.append((placed._jdf.queryExecution().optimizedPlan().toString(), {r[0] for r in placed.select("token").collect()}, open_now))
        return meet(placed, *rest)

    monkeypatch.setattr(jaccard, "_meet", seen)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.similar_groups(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == brute_groups([(r[0], r[1]) for r in rows], 4, 85)
    assert len(turns) > 1
    assert not any("Join" in plan for plan, _, _ in turns)  # a join here would be done again by each reader
    assert all(tokens <= before for (_, tokens, _), (_, _, before) in zip(turns[1:], turns))


def _records_shuffled(plan) -> int:
    name = plan.getClass().getSimpleName()
    if name == "AdaptiveSparkPlanExec":
        return _records_shuffled(plan.executedPlan())
    if name.endswith("QueryStageExec"):
        return _records_shuffled(plan.plan())
    own = plan.metrics().apply("shuffleRecordsWritten").value() if name == "ShuffleExchangeExec" else 0
    return own + sum(_records_shuffled(plan.children().apply(i)) for i in range(plan.children().size()))


@pytest.mark.parametrize("ends", [200_000, 0])
def test_few_pairs_shuffle_few_sets(spark, ends, monkeypatch):
    monkeypatch.setattr(jaccard, "FEW_ENDS", ends, raising=False)
    common = list(range(20))
    sets = [(i, 20, common[:4] if i < 4 else [i], common[:4] if i < 4 else [i], common if i < 4 else [i] * 20) for i in range(2000)]
    prefixes = jaccard.materialize(spark.createDataFrame(sets, "node long, n long, p1 array<long>, p2 array<long>, common array<long>"))
    pairs = jaccard.materialize(spark.createDataFrame([(0, 1), (2, 3), (4, 5)], "a long, b long"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        links = jaccard._verify(pairs, prefixes, 85)
        assert sorted(tuple(r) for r in links.collect()) == [(0, 1), (2, 3)]
        if ends:
            assert _records_shuffled(links._jdf.queryExecution().executedPlan()) < 100
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_one_row_of_each_group_stays(spark):
    rows = rows_of(["a b c d e f", "a b c d e f", None, "", "q r s t u v", "g h i j k l"])
    rows += [(4, "q r s t u v", "en", "s", 0, "x"), (4, "q r s t u v", "en", "s", 0, "x"), (None, "a b c d e f", "en", "s", 0, "x"), (None, "", "en", "s", 0, "x")]
    rows += [(1, "text unlike the removed copy one", "en", "s", 0, "x")]  # shares the id of a removed copy
    rows += [(None, "only rows without any id here", "en", "s", 0, x) for x in "yxz"]
    rows += [(3, "A B C D E F", "en", "s", 0, "x")]  # a copy that shares the id of an empty text
    kept = jaccard.one_row_of_each_group(spark.createDataFrame(rows, DOCS).repartition(3), k=5, percent=80)
    assert kept.columns == [c.split()[0] for c in DOCS.split(", ")]
    want = [("0", "a b c d e f"), ("1", "text unlike the removed copy one"), ("2", None), ("3", ""), ("4", "q r s t u v"), ("5", "g h i j k l"), ("None", ""), ("None", "only rows without any id here")]
    got = kept.collect()
    assert sorted((str(r["doc_id"]), r["text"] or "", r["text"] is None) for r in got) == sorted((i, t or "", t is None) for i, t in want)
    assert {r["start"] for r in got if (r["text"] or "").startswith("only")} == {"x"}
    plain = rows_of(["a b c d e f", "a b c d e f", None, "g h i j k l"])
    assert sorted(r["doc_id"] for r in jaccard.one_row_of_each_group(spark.createDataFrame(plain, DOCS), k=5, percent=80).collect()) == [0, 2, 3]


def test_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (5, 5), (None, 3)]
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}


# 9 mixing


def test_raking_against_numpy(spark):
    rng = random.Random(6)
    rows = [(i, "x " * rng.randrange(0, 50), rng.choice(["en", "de", None]), rng.choice(["s1", "s2", "s3"]), 0, rng.choice(["p", "q"])) for i in range(3000)]
    docs = spark.createDataFrame(rows, DOCS).withColumnRenamed("start", "topic")
    targets = {"source": {"s1": 0.5}, "lang": {"en": 0.6, "de": 0.3, None: 0.1, "absent": 0.4}, "topic": {"p": 0.3, "q": 0.7}}
    got = mixing.mix(docs, targets, F.length("text")).collect()
    cells = collections.Counter()
    for r in rows:
        cells[(r[3], r[2], r[5])] += len(r[1])
    total = sum(cells.values())
    free = sum(v for k, v in cells.items() if k[0] != "s1")
    want = [{"s1": 0.5, **{s: 0.5 * sum(v for k, v in cells.items() if k[0] == s) / free for s in ("s2", "s3")}}, {"en": 0.6 / 1.4, "de": 0.3 / 1.4, None: 0.1 / 1.4}, {"p": 0.3, "q": 0.7}]
    want[1] = {k: v / sum(want[1].values()) for k, v in want[1].items()}
    w = {k: v / total for k, v in cells.items()}
    for _ in range(200):
        for d in range(3):
            sums = collections.Counter()
            for k, v in w.items():
                sums[k[d]] += v
            w = {k: v * want[d][k[d]] / sums[k[d]] for k, v in w.items()}
    rate = {k: w[k] / cells[k] for k in w}
    top = max(rate.values())
    assert len(got) == 3000
    for r in got:
        assert r["sample_rate"] == pytest.approx(rate[(r["source"], r["lang"], r["topic"])] / top, abs=1e-4)
    assert sum(r["copies"] for r in got) == pytest.approx(sum(r["sample_rate"] for r in got), rel=0.05)
    assert mixing.mix(docs.limit(0), targets, F.length("text")).count() == 0


def test_rare_cell_repeats_and_the_others_stay(spark):
    import corpus_pipeline

    rng = random.Random(7)
    sizes = {"note": 40, "article": 250, "book": 900}
    rows = [(i, "word " * sizes[rng.choice(["article"] * 8 + ["book"] * 4 + ["note"])], rng.choice(["en"] * 5 + ["de", "fr", "es"]), f"s{i % 5}", 0, "x") for i in range(1000)]
    rows.append((1000, "| a | b |" * 100, "en", "s1", 0, "x"))
    docs = spark.createDataFrame(rows, DOCS)
    tokens = {r["doc_id"]: r["n"] for r in docs.select("doc_id", mixing.estimated_tokens().alias("n")).collect()}
    kept = corpus_pipeline.mixing_stage(spark, docs, "").collect()
    assert len({r["doc_id"] for r in kept} - {1000}) > 600
    total = sum(tokens[r["doc_id"]] for r in kept)
    assert sum(tokens[r["doc_id"]] for r in kept if r["doc_id"] == 1000) / total == pytest.approx(0.03, rel=0.1)
    assert total == pytest.approx(sum(tokens.values()), rel=0.1)


def test_values_without_a_target_stay(spark):
    rng = random.Random(8)
    rows = [(i, "word " * rng.choice([40, 250, 900]), rng.choice(["en"] * 30 + ["de", "fr", "es"] * 6 + [None, "it"]), f"s{i % 4}", 0, "x") for i in range(1500)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("_form", mixing.form_topic())
    for keep in ({"en", "de", "fr", "es", "it", None}, {"en", "it", None}):  # also where targets are left out
        some = docs.filter(F.coalesce("lang", F.lit("it")).isin([x for x in keep if x]))
        got = mixing.mix(some, mixing.TARGETS, F.length("text"), most=None).collect()
        sizes, mixed = collections.Counter(), collections.Counter()
        for r in got:
            sizes[r["lang"]] += len(r["text"])
            mixed[r["lang"]] += len(r["text"]) * r["sample_rate"]
        for lang in (None, "it"):
            assert min(r["sample_rate"] for r in got if r["lang"] == lang) > 0
            assert mixed[lang] / sum(mixed.values()) == pytest.approx(sizes[lang] / sum(sizes.values()), rel=1e-3)
        named = sum(v for k, v in mixed.items() if k in mixing.TARGETS["lang"])
        asked = sum(mixing.TARGETS["lang"][k] for k in keep if k in mixing.TARGETS["lang"])
        assert all(mixed[k] / named == pytest.approx(mixing.TARGETS["lang"][k] / asked, rel=1e-3) for k in keep if k in mixing.TARGETS["lang"])


def test_draw_tells_rows_without_an_id_apart(spark):
    targets = {"lang": {"en": 0.8, "de": 0.2}}
    rows = [(None, f"text {i}", "en" if i % 2 else "de", "s", 0, "x") for i in range(2000)]
    same = [(1, "equal rows", "en" if i % 2 else "de", "s", 0, "x") for i in range(2000)]
    for each in (rows, same):
        docs = spark.createDataFrame(each, DOCS).withColumns({"sample_rate": F.lit("own"), "copies": F.lit(9), "topic": F.lit("t")})
        got = mixing.mix(docs, targets, mixing.estimated_tokens(), most=None).groupBy("lang").agg(F.sum("copies").alias("c")).collect()
        sums = {r["lang"]: r["c"] for r in got}
        assert sums["en"] == pytest.approx(1600, rel=0.1) and sums["de"] == pytest.approx(400, rel=0.2)


def test_many_copies_of_one_row(spark):
    mixed = spark.createDataFrame([(1, "a", 1000), (2, "b", 0), (3, "c", 1), (4, "d", 64), (5, "e", 65)], "doc_id long, text string, copies long")
    got = {r["doc_id"]: r["count"] for r in mixing.drawn(mixed, ["doc_id", "text"]).groupBy("doc_id").count().collect()}
    assert got == {1: 1000, 3: 1, 4: 64, 5: 65}


def test_mixing_stays_in_the_jvm(spark, sf_dir):
    from claimsieve.llm.queries import QUERIES

    assert not re.search("Python|Arrow|Pandas", QUERIES["op9_mixing"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString())


def test_estimate_follows_the_tokenizer(docs):
    """Shares of each language by estimated and by counted tokens."""
    counted, estimated = collections.Counter(), collections.Counter()
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for r in docs.select("lang", "text", mixing.estimated_tokens().alias("n")).collect():
        counted[r["lang"]] += len(library.encode(r["text"] or "").ids)
        estimated[r["lang"]] += r["n"]
    gaps = {k: estimated[k] / sum(estimated.values()) / (v / sum(counted.values())) - 1 for k, v in counted.items()}
    print("share by estimate against counted ids", {k: f"{v:+.1%}" for k, v in gaps.items()})
    assert all(abs(v) < 0.2 for v in gaps.values())


# 10 archives


def test_archives_round_trip(spark, sf_dir):
    pages = [(1, "http://a", "<p>é</p>"), (2, "b", "<p>é</p>"), (0, None, None), (3, "c\r\nX: y", ""), (9, "d", "x" * 300_000), (8, "e", "x" * 300_000), (None, "f", "<p>é</p>")]
    table = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)
    got = {r["page_id"]: r for r in warc.archive_pages(table).collect()}
    assert len(got) == len(pages)
    for i, _, html in pages:
        raw = (html or "").encode()
        first = min(p[0] for p in pages if p[0] is not None and (p[2] or "") == (html or ""))
        assert got[i]["payload_bytes"] == len(raw) and got[i]["payload_digest"] == base64.b32encode(hashlib.sha1(raw).digest()).decode()
        assert (got[i]["record_type"], got[i]["refers_to"]) == (("response", None) if i == first else ("revisit", first))
    given = spark.read.parquet(f"{sf_dir}/pages.parquet")
    index = warc.write_archives(given, f"{warc.scratch_path(spark, 'warc-test')}")
    few = warc.read_records(spark, index.filter("page_id % 7 = 0"), gap=100, payload=True)
    want = {r["page_id"]: r["html"].encode() for r in given.filter("page_id % 7 = 0").collect()}
    assert {r["page_id"]: bytes(r["payload"]) for r in few.collect()} == want
    assert warc.byte_ranges(index, size=20_000).count() > warc.byte_ranges(index).count() and warc.archive_pages(table.limit(0)).count() == 0


# pipeline


def test_pipeline_stages_against_their_rules(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, now, kept = docs.columns, docs, []
    for name, stage in corpus_pipeline.STAGES[:4]:
        now = corpus_pipeline.materialize(stage(spark, now, sf), "stage")
        assert now.columns == columns
        kept.append({r["doc_id"]: r["text"] for r in now.collect()})
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    base = {i: brute_base(t) for i, t in texts.items()}
    fails = {i for i, b in base.items() if b[0] < 20 or 100 * b[4] > 30 * b[0]}
    assert not fails & set(kept[0]) and all(i in kept[0] for i, q in labels.items() if q == 1 and i not in fails)
    groups = brute_groups(list(kept[0].items()), 5, 80)
    assert set(kept[1]) == {i for i in kept[0] if groups[i][1] == i}
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert set(kept[2]) == {i for i, t in kept[1].items() if not brute_hits(t, items)[1]}
    assert set(kept[3]) <= set(kept[2]) and len(kept[3]) > 0.3 * len(kept[2])
    last = corpus_pipeline.STAGES[4][1](spark, now, sf).collect()
    assert {r["doc_id"] for r in last} == set(kept[3]) and sum(r["n_tokens"] for r in last) == max(r["start"] + r["n_tokens"] for r in last)
