"""Secrets, mixing, BPE, toxicity, licences, URLs, HTML and the pipeline."""

import hashlib
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixmill.llm import _common, bpe, html_extract, licences, mixing, secret_scan, toxicity, url_filter

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t) if t is not None else None) for i, t, s in rows], DOCS)


# secrets

HEX = "0123456789abcdef" * 2
CASES = [None, "", "plain", f'token = "{HEX}"', "PassWord:abcdef x", "secret=abc", "secret=token:abcdefgh", "api_key='k-e.y/1=='", f"AKIA{'A1' * 8} AKIA12", f"x{HEX}{HEX}g{HEX[:23]}", f"é😀 passwd =  'zzzzzzz' {HEX}", "token:" + "a" * 5000, ("apikey: 12345678 " * 400), "-----BEGIN RSA PRIVATE KEY-----\nxx"]


def plain_base(text):
    text, out = text or "", []
    for m in re.finditer(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text, re.I | re.A):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, m.end(), "assign"))
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


def test_secret_report(spark):
    rows = [(k, t, "s") for k, t in enumerate(CASES)] + [(99, CASES[3], "s"), (99, CASES[3], "s"), (None, CASES[4], "s")]
    df = docs(spark, rows).withColumn("spans", F.lit("clash")).withColumn("blob", F.lit(1))
    got = secret_scan.report(df).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    for i, t, _ in rows:
        base = plain_base(t)
        text = ",".join(f"{k}:{s}:{e}" for s, _, e, k in base)
        assert by[i].base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert [by[i].n_assign, by[i].n_access, by[i].n_hex] == [sum(b[1] == n for b in base) for n in range(3)]
        assert set(filter(None, text.split(","))) <= set(by[i].spans.split(","))
    assert "pem:0:31" in by[13].spans
    assert secret_scan.report(df.limit(0)).collect() == []


def test_ledger_scans_only_unseen(spark, tmp_path, monkeypatch):
    ledger, columns = str(tmp_path / "ledger"), "id long, text string"
    entries = lambda: spark.read.schema(secret_scan.LEDGER).parquet(ledger).collect()
    one = spark.createDataFrame([(1, CASES[3]), (2, CASES[4]), (3, CASES[3]), (1, CASES[8])], columns)  # versions of path 1
    first = {(r.id, r.spans) for r in secret_scan.report(one, "id", ledger=ledger).collect()}
    assert len(entries()) == 3 and {len(r.rules) for r in entries()} == {len(secret_scan.RULES)}
    # a second run over the same texts scans nothing and reports all
    monkeypatch.setattr(secret_scan, "spans_of", lambda *a: pytest.fail("scanned again"))
    assert {(r.id, r.spans) for r in secret_scan.report(one, "id", ledger=ledger).collect()} == first
    assert len(entries()) == 3
    monkeypatch.undo()
    # known and new blobs: only the new one is scanned, the known one's findings reach the new path
    two = spark.createDataFrame([(4, CASES[3]), (5, CASES[9])], columns)
    got = {r.id: r.spans for r in secret_scan.report(two, "id", ledger=ledger).collect()}
    assert len(entries()) == 4 and got[4] == next(s for i, s in first if i == 3) and got[5]
    # a rule of a new version is scanned alone, once, and its findings take the place of the old version's
    rules = tuple(secret_scan.Rule(r.kind, r.pattern, r.group, 40 if r.kind == "hex" else r.least, r.version + (r.kind == "hex"), r.base) for r in secret_scan.RULES)
    again = {r.id: r for r in secret_scan.report(two, "id", rules=rules, ledger=ledger).collect()}
    assert sorted(len(r.rules) for r in entries()) == [1, 1, 7, 7, 7, 7]
    assert again[4].n_hex == 0 and again[4].n_assign == 1 and again[5].n_hex == 1
    assert {(r.id, r.spans) for r in secret_scan.report(one, "id", ledger=ledger).collect()} == first


def test_findings_reach_all_copies_beyond_the_broadcast_limit(spark, monkeypatch):
    rows = [(k, CASES[3] if k % 2 else f"secret=abcdef{k}", "s") for k in range(60)]
    want = sorted(map(str, secret_scan.report(docs(spark, rows)).collect()))
    clean = sorted(map(str, secret_scan.redact(docs(spark, rows)).collect()))
    for module in (secret_scan, _common):
        monkeypatch.setattr(module, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(_common, "HOT_KEYS", 10)
    assert sorted(map(str, secret_scan.report(docs(spark, rows)).collect())) == want
    assert sorted(map(str, secret_scan.redact(docs(spark, rows)).collect())) == clean


def test_many_secrets_in_one_text(spark):
    text = "password=abcdefg " * 30_000
    began = time.time()
    got = secret_scan.report(docs(spark, [(1, text, "s")])).collect()[0]
    assert got.n_assign == 30_000 and got.spans.endswith(f"assign:{17 * 29_999}:{17 * 30_000 - 1}") and time.time() - began < 60
    assert secret_scan.redact(docs(spark, [(1, text, "s")])).collect()[0].text == "[SECRET] " * 30_000


def test_redact(spark):
    df = docs(spark, [(k, t, "s") for k, t in enumerate(CASES)])
    got = {r.doc_id: r for r in secret_scan.redact(df).collect()}
    assert got[2].text == "plain" and got[0].text is None and got[3].text == '[SECRET]"'
    assert got[4].text == "[SECRET] x" and got[4].n_chars == 10
    assert all(not plain_base(r.text) for r in got.values())


# mixing


def plain_mix(rows):
    names = sorted({s for _, _, s in rows}, key=lambda s: (s is None, s or ""))
    size = {s: sum(len((t or "").split()) for _, t, x in rows if x == s) for s in names}
    w = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    total, capped = 1.5 * sum(size.values()), set()
    while True:
        free = [s for s in names if s not in capped]
        rate = (total - sum(2 * size[s] for s in capped)) / sum(w[s] for s in free) if free else 0
        new = {s for s in free if w[s] * rate > 2 * size[s]}
        if not new:
            return {s: 2.0 * size[s] if s in capped else w[s] * rate for s in names}, size
        capped |= new


def test_mix(spark):
    pick = random.Random(6)
    rows = [(k, " ".join("w" for _ in range(pick.randint(0, 40))), pick.choice(["a", "b", "c", "d", None, "É"])) for k in range(300)]
    rows += [(500, None, "a"), (501, "x " * 3000, "b"), (7, "same id", "b"), (None, "no id", "c"), (502, "", "empty")]
    df = docs(spark, rows).withColumn("size", F.lit(1)).withColumn("key", F.lit(1))
    got = mixing.mix(df).collect()
    target, size = plain_mix(rows)
    assert len(got) == len(rows)
    taken = {}
    for r in got:
        assert abs(r.target - target[r.source]) < 1e-6 and r.source_size == size[r.source] and 0 <= r.taken <= 2 * r["size"]
        taken[r.source] = taken.get(r.source, 0) + r.taken
    assert all(abs(taken[s] - target[s]) <= 1 for s in target)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(df.repartition(7)).collect()))
    whole = mixing.mixed_documents(df.where("doc_id is not null and doc_id <> 7"))
    assert whole.columns == df.columns and set(r.text for r in whole.collect()) <= set(t for _, t, _ in rows)
    assert mixing.mix(df.limit(0)).collect() == []


# BPE


def test_bpe_equals_the_library(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    pick = random.Random(8)
    alphabet = "abcdefghijklmnopqrstuvwxyz'ABCé 09.,!?$\n\tßñ日🙂<|>/"
    rows = [None, "", " ", "<|startoftext|>Hi<|endoftext|>", "don't we'll 'S", "e\u0301 \u0301x", "a\x1cb", "ΣΑΣ İ ﬁ", "x" * 3000, "ab" * 2000, "w1 " * 5000]
    rows += ["".join(pick.choice(alphabet) for _ in range(pick.randint(0, 80))) for _ in range(300)]
    df = docs(spark, [(k, t, "s") for k, t in enumerate(rows)]).withColumn("ids", F.lit(1))
    got = {r.doc_id: r for r in bpe.encode_decode(df, path, ids=True).collect()}
    assert len(got) == len(rows)
    for k, t in enumerate(rows):
        want = library.encode(t or "", add_special_tokens=False).ids
        assert list(got[k].ids) == want and got[k].n_tokens == len(want)
        assert got[k].ids_sha256 == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest()
        assert got[k].decoded_sha256 == hashlib.sha256(library.decode(want, skip_special_tokens=False).encode()).hexdigest()
    texts = {r.doc_id: r.decoded for r in bpe.decode(bpe.encode_decode(df, path, ids=True), path).collect()}
    assert texts[3] == library.decode(library.encode(rows[3], add_special_tokens=False).ids, skip_special_tokens=False)
    assert bpe.encode_decode(df.limit(0), path).collect() == []


def test_bpe_verification_finds_wrong_proposals():
    import public_tokenizers

    e = bpe.WordBpe(open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read())
    words = ["thehe", "retionth", "anththe", "hello", "xyzzyq", "erertion"]
    e.encode_words(words)
    for w in words:
        assert e.words[w] == " ".join(map(str, e.merge(e.symbols(w + "</w>"))))
    long = [e.vocab[c] for c in "abcthe" * 60]
    assert e._merge_long(list(long)) == slow_merge(e, list(long))


def slow_merge(e, ids):
    while True:
        ranked = [(e.rank.get(a << 32 | b), k) for k, (a, b) in enumerate(zip(ids, ids[1:]))]
        ranked = [x for x in ranked if x[0] is not None]
        if not ranked:
            return ids
        r, k = min(ranked)
        ids[k : k + 2] = [e.merged[r]]


# toxicity


def test_toxicity_held_out(spark):
    pick = random.Random(10)
    words = [f"word{k}" for k in range(200)]
    rows, labels = [], []
    for k in range(900):
        bad = k % 6 == 0
        body = pick.choices(words, k=pick.randint(20, 200))
        for _ in range(pick.randint(2, 8) if bad else 0):
            body.insert(pick.randrange(len(body)), pick.choice(["Idiot,", "scum", "moron!", "trash."]))
        rows.append((k, " ".join(body), "s"))
        labels.append((k, 1, int(bad)))
    rows += [(1000, None, "s"), (1001, "", "s"), (1002, "word1 " * 30000, "s"), (None, "scum idiot trash moron", "s"), (1003, "scum idiot trash moron", "s")]
    df = docs(spark, rows).withColumn("severity", F.lit(0)).withColumn("toxic", F.lit(0))
    lab = spark.createDataFrame(labels[:600] + [(5, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.train(df, lab)
    assert model.thresholds == sorted(model.thresholds)
    got = {r.doc_id: r for r in toxicity.rate(df, model).collect()}
    wrong = sum(got[k].toxic != bool(t) for k, _, t in labels[600:])
    assert wrong <= 3
    assert not any(got[k].toxic for k in (1000, 1001, 1002)) and got[1003].toxic and got[None].toxic
    assert got[1003].severity <= 3.0 and got[1000].severity < 0.2
    empty = toxicity.train(df, lab.limit(0))
    assert not any(r.toxic for r in toxicity.rate(df, empty).collect())
    assert toxicity.rate(df.limit(0), model).collect() == []


# licences


def test_licences(spark):
    gpl = "This work is licensed under the GNU General Public License, version 3."
    rows = [(1, "a/LICENSE", gpl), (2, "a/x/y.txt", "plain words"), (3, "a/x/z.txt", "code\nReleased under the MIT License.\nmore code here and there and everywhere else " * 3), (4, "b/q.txt", "plain"), (5, "a/x/LICENSE", "Licensed under the Apache License, Version 2.0."), (6, None, None), (7, "a/w.txt", ""), (8, "a/x/deep/er/f.txt", "nothing"), (9, "c/long.txt", "word " * 40000)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "id long, path string, text string, dir string")
    got = {r.id: r for r in licences.scan(df).collect()}
    assert [got[k].licence for k in range(1, 10)] == ["GPL-3.0", "Apache-2.0", "MIT", None, "Apache-2.0", None, "GPL-3.0", "Apache-2.0", None]
    assert got[8].inherited_from == "a/x/LICENSE" and got[7].inherited_from == "a/LICENSE" and got[3].inherited_from is None
    assert licences.scan(df.limit(0)).collect() == []


def test_anchors_lose_nothing():
    s = licences.Scanner(licences.TEMPLATES, 1000, {"license": 100, "the": 900, "this": 800, "under": 300}, 0.6)
    pick = random.Random(12)
    vocab = sorted(s.idf)
    for _ in range(2000):
        words = pick.choices(vocab, k=pick.randint(1, 12))
        if s.cosine(words)[0] >= s.threshold:
            assert s.anchors.intersection(words)


# URLs


def test_url_rules_and_model(spark):
    from helixmill.llm.queries import URL_RULES

    rows = [(1, "http://A.Example.com/en/x?y#z"), (2, "https://www.example.com/en/1"), (3, "http://x.example.com/fr/"), (4, "http://q.net/es/1"), (5, "http://com"), (6, None), (7, "no scheme"), (8, ""), (9, "http://h.org/en/1"), (10, "ftp://a://b/c"), (9, "http://h.org/en/1")]
    rows += [(100 + k, f"http://good{k}.example.com/fr/{k}") for k in range(40)] + [(200 + k, f"http://casino{k}.example.net/es/{k}") for k in range(40)]
    rows += [(300, "http://good99.example.org/de/1"), (301, "http://casino99.example.org/es/7"), (302, "http://x.org/" + "a" * 3000)]
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], "page_id long, url string, host string, rest string")
    got = {r.page_id: r for r in url_filter.judge(df, URL_RULES).collect()}
    assert (got[1].host, got[1].path, got[1].rule, got[1].verdict) == ("a.example.com", "/en/x", "example.com/en/", "block")
    assert (got[2].rule, got[2].verdict) == ("www.example.com/en/", "allow") and got[3].rule == "com/" and got[4].rule == "net/es/"
    assert (got[5].host, got[5].path, got[5].rule) == ("com", "", None)
    assert (got[6].host, got[6].path, got[6].rule, got[6].verdict) == ("", "", None, "block") and got[7].host == "" and got[8].verdict == "block"
    assert (got[10].host, got[10].path) == ("a:", "//b/c")
    assert got[300].verdict == "allow" and got[301].verdict == "block"
    assert len(url_filter.judge(df, URL_RULES).collect()) == len(rows)
    assert url_filter.judge(df.limit(0), URL_RULES).collect() == []
    assert {r.verdict for r in url_filter.judge(df.where("page_id = 9"), URL_RULES).collect()} == {"allow"}


def test_language_models_learn_from_all_urls(spark, monkeypatch):
    from helixmill.llm.queries import URL_RULES

    monkeypatch.setattr(url_filter, "FIT_ROWS", 30, raising=False)
    seen, fit = [], url_filter.fit
    monkeypatch.setattr(url_filter, "fit", lambda rows: seen.append(rows.count()) or fit(rows))
    rows = [(k, f"http://good{k}.example.com/fr/{k}") for k in range(200)] + [(200 + k, f"http://casino{k}.example.net/es/{k}") for k in range(200)] + [(900, "http://x.org/de/")]
    url_filter.judge(spark.createDataFrame(rows, "page_id long, url string"), URL_RULES).collect()
    assert 280 <= seen[0] <= 360  # four fifths of 400, by digest


def test_url_threshold_over_slices(spark, monkeypatch):
    pick = random.Random(5)
    known = [(round(pick.gauss(0.4 * y, 0.5), 2), y) for y in (0, 1) for _ in range(300)]
    df, scores = spark.createDataFrame(known, "score double, y int"), sorted({s for s, _ in known})
    good = lambda t: sum(s <= t for s, y in known if not y) + sum(s > t for s, y in known if y)
    ends = [(a + b) / 2 for a, b in zip(scores, [*scores[1:], scores[-1]])]
    best = max(map(good, ends))
    for n in (10, 50_000):
        monkeypatch.setattr(url_filter, "SCORES", n)
        assert good(url_filter.threshold(df)) == best
    assert url_filter.threshold(df.where("y = 0")) == 0.0


# HTML


def test_html_layouts(spark):
    pick = random.Random(14)
    words = [f"word{k}" for k in range(400)]
    para = lambda: " ".join(pick.choices(words, k=pick.randint(1, 60))).capitalize() + "."
    article = lambda b: "<html><head><title>t</title><script>var x='</p>';</script></head><body><nav><ul><li><a href='/a'>Home</a></li></ul></nav><div class=\"ad\">Buy</div><article><h1>" + b[0] + "</h1>" + "".join(f"<p>{x}</p>" for x in b[1:]) + "</article><footer>&copy; me</footer></body></html>"
    train = [[para() for _ in range(pick.randint(2, 9))] for _ in range(120)]
    trees = html_extract.fit([article(b) for b in train])
    other = [para() for _ in range(300)]
    good = 0
    for _ in range(100):
        b = [para() for _ in range(pick.randint(2, 9))]
        assert html_extract.main_texts([article(b)], trees) == ["\n".join(b)]
        good += html_extract.main_texts([html_extract.layout(b, other, pick).replace(html_extract.MARK, "")], trees) == ["\n".join(b)]
    assert good >= 90
    odd = ["<article><h1>A &amp; B</h1><p>x\n <b>y</b>z<p>two &lt;br&gt;<br>three</article>", None, "", "<", "<<<p", "<p>" * 3000, "<div>" * 3000 + "x", "<!-- <article><p>no</p></article> -->"]
    got = html_extract.main_texts(odd, trees)
    assert got[0] == "A & B\nx yz\ntwo <br> three" and got[1] == got[2] == got[7] == ""
    df = spark.createDataFrame([(k, "u", h, "c") for k, h in enumerate(odd)] + [(None, None, odd[0], "c")], "page_id long, url string, html string, text string")
    out = html_extract.extract(df, html_extract.train(df)).collect()
    assert len(out) == len(odd) + 1 and all(r.n_chars == len(r.text) for r in out)
    assert html_extract.train(df.limit(0)) is None and html_extract.extract(df.limit(0), None).collect() == []


# pipeline


@pytest.mark.skipif(not __import__("os").path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_pipeline_against_plain_steps(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    import corpus_pipeline as p
    from helixmill.llm import simhash

    d = "/root/testdata/sf0.001"
    base = spark.read.parquet(f"{d}/documents.parquet")
    kept = [r for r in p.drop_toxic(spark, base, d).collect()]
    model = toxicity.train(base, spark.read.parquet(f"{d}/labels.parquet"))
    assert sorted(r.doc_id for r in kept) == sorted(r.doc_id for r in base.collect() if round(model.severity(r.text), 6) < 0.5)
    fp = {r.doc_id: simhash.fingerprint(r.text) for r in kept}
    parent = {}
    for i in sorted(fp):
        near = [j for j in parent if bin(fp[i] ^ fp[j]).count("1") <= 3]
        low = min([i] + [parent[j] for j in near])
        old = {parent[j] for j in near}
        parent[i] = low
        for j in parent:
            if parent[j] in old:
                parent[j] = low
    uniq = p.drop_near_duplicates(spark, spark.createDataFrame(kept, base.schema), d).collect()
    assert sorted(r.doc_id for r in uniq) == sorted(i for i in parent if parent[i] == i)
    clean = p.redact_secrets(spark, spark.createDataFrame(uniq, base.schema), d).collect()
    assert len(clean) == len(uniq) and not any(plain_base(r.text) for r in clean)
    mixed = p.mix_sources(spark, spark.createDataFrame(clean, base.schema), d).collect()
    target, _ = plain_mix([(r.doc_id, r.text, r.source) for r in clean])
    size = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for r in clean}
    for s, t in target.items():
        own = [size[r.doc_id] for r in mixed if r.source == s]
        assert abs(sum(own) - t) <= max([size[r.doc_id] for r in clean if r.source == s], default=0)
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    text = {r.doc_id: r.text for r in clean}
    last = p.run(spark, d).collect()
    assert sorted(r.doc_id for r in last) == sorted(r.doc_id for r in mixed)
    for r in last[:50]:
        assert list(r.ids) == library.encode(text[r.doc_id], add_special_tokens=False).ids
