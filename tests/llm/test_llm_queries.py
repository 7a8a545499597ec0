"""The registered queries against brute force over a small fixture, and over empty tables."""

import hashlib
import re
import zlib
from collections import Counter

import pytest

from repoquarry.llm import queries as Q

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def rows_of(spark, corpus, name):
    return Q.QUERIES[name](spark, corpus).collect()


def texts(spark, corpus):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{corpus}/documents.parquet").collect()]


@pytest.mark.parametrize("name", list(Q.QUERIES))
def test_empty_tables(spark, empty, name):
    assert rows_of(spark, empty, name) == []


def test_warc(spark, corpus):
    pages = [(r["page_id"], (r["html"] or "").encode()) for r in spark.read.parquet(f"{corpus}/pages.parquet").collect()]
    want = Counter()
    for i, body in pages:
        last = max((j for j, other in pages if other == body and j is not None), default=None) if len(body) >= 1000 else i
        kind = ("response", None) if last == i else ("revisit", last)
        want[i, len(body), hashlib.sha1(body).hexdigest(), *kind] += 1
    got = Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in rows_of(spark, corpus, "op2_warc"))
    assert got == want


def test_licences(spark, corpus):
    phrases = {"mit": ["mit", "license"], "apache": ["apache", "license"], "gpl": ["general", "public", "license"]}
    want = Counter()
    for i, text in texts(spark, corpus):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
        at = sorted((k, label) for label, p in phrases.items() for k in range(len(words)) if words[k : k + len(p)] == p)
        want[i, len(words), len(at), at[0][0] if at else None, at[-1][0] if at else None, ",".join(sorted({x for _, x in at}))] += 1
    rows = rows_of(spark, corpus, "op3_license_scan")
    assert Counter((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in rows) == want
    assert all(set(r["base_labels"].split(",")) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1 for r in rows)


def test_near_duplicates(spark, corpus):
    sets = {}
    for i, text in texts(spark, corpus):
        words = SPACE.findall((text or "").translate(LOWER))
        sets[i] = {tuple(words[k : k + 3]) for k in range(len(words) - 2)} or ({tuple(words)} if words else set())
    parent = {i: i for i in sets if i is not None}
    for _ in parent:
        for i in parent:
            for j in parent:
                both, every = len(sets[i] & sets[j]), len(sets[i] | sets[j])
                if every and 100 * both >= 85 * every:
                    parent[i] = parent[j] = min(parent[i], parent[j])
    rows = rows_of(spark, corpus, "op4_minhash_near_dedup")
    assert len(rows) == len(texts(spark, corpus))
    for r in rows:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[r["doc_id"]]), parent[r["doc_id"]], parent[r["doc_id"]] == r["doc_id"])


def test_packing(spark, corpus):
    import numpy as np
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(Q.tokenizer_path())
    want = Counter()
    for i, text in texts(spark, corpus):
        ids, at = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4"), 0
        rest = len(ids)
        while rest:
            size = min(2048, 1 << rest.bit_length() - 1)
            want[i, at, size, zlib.crc32(ids[at : at + size].tobytes()), len(ids), 0] += 1
            at, rest = at + size, rest - size
    rows = rows_of(spark, corpus, "op5_packing")
    assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"], r["offset"]) for r in rows) == want
    assert len({r["sequence_id"] for r in rows}) == len(rows)


def luhn(digits):
    values = [int(c) * (1 + k % 2) for k, c in enumerate(reversed(digits))]
    return sum(v - 9 if v > 9 else v for v in values) % 10 == 0


def test_personal_data(spark, corpus):
    patterns = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }
    want = Counter()
    for i, text in texts(spark, corpus):
        found = []
        for kind, pattern in patterns.items():
            for m in re.finditer(pattern, text or ""):
                digits = re.sub("[^0-9]", "", m.group())
                if {"email": True, "ip": kind != "ip" or all(int(x) < 256 for x in m.group().split(".")), "card": 16 <= len(digits) <= 19 and luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]:
                    found.append(f"{kind}:{m.start()}:{m.end()}")
        counts = [sum(f.startswith(kind + ":") for f in found) for kind in patterns]
        want[i, *counts, hashlib.sha256(",".join(found).encode()).hexdigest()] += 1
    rows = rows_of(spark, corpus, "op6_pii")
    assert Counter((r["doc_id"], r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"]) for r in rows) == want
    assert any(r["spans"].startswith("email:") and ",card:" in r["spans"] for r in rows)


def test_quality_counts(spark, corpus):
    want = Counter()
    for i, text in texts(spark, corpus):
        text = text or ""
        words = SPACE.findall(text)
        windows = Counter(tuple(words[k : k + 3]) for k in range(len(words) - 2))
        repeated = {k + d for k in range(len(words) - 2) if windows[tuple(words[k : k + 3])] > 1 for d in range(3)}
        lines = [line for line in text.split("\n") if SPACE.search(line)]
        want[i, len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(repeated), len(words) < 50 or 100 * len(repeated) > 50 * len(words)] += 1
    rows = rows_of(spark, corpus, "op10_quality_rules")
    assert Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in rows) == want
    assert not any(r["kept"] and r["base_failed"] for r in rows)


def test_learnt_scores(spark, corpus):
    toxic, lang = rows_of(spark, corpus, "op7_toxicity"), rows_of(spark, corpus, "op8_language_id")
    assert len(toxic) == len(lang) == len(texts(spark, corpus))
    for r in toxic:
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3)
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
    for r in lang:
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
        assert (r["lang_pred"] == "und") == (r["bits"] == 0) and 0 <= r["score"] <= 1
    assert {r["doc_id"] for r in lang if r["lang_pred"] == "und"} == {5, 6, 7, 15, 17, None}


def test_leaks(spark, corpus):
    assert [(r["doc_id"], r["item_id"], r["question"], r["answer"]) for r in rows_of(spark, corpus, "op9_decontamination")] == [(11, 7, 1.0, 1.0)]


def test_secrets(spark, corpus):
    rows = [r for r in rows_of(spark, corpus, "op1_secret_scan") if r["secret"]]
    assert [(r["doc_id"], r["start"], r["end"]) for r in rows] == [(13, 9, 49)]
