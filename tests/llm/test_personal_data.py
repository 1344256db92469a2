"""Base spans against Python's regular expressions; terms on a corpus made to disclose one."""

import hashlib
import random
import re

from cases import ROWS, documents
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from proofyard.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def valid(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "phone":
        return 8 <= len(digits) <= 15
    if kind == "card":
        total = sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for i, c in enumerate(reversed(digits)))
        return 16 <= len(digits) <= 19 and total % 10 == 0
    return True


def brute(text):
    return [f"{k}:{m.start()}:{m.end()}" for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if valid(k, m.group())]


def check(spark, texts, tmp_path):
    df = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    df.write.mode("overwrite").parquet(f"{tmp_path}/t")
    got = {r["doc_id"]: r for r in pii.find(spark.read.parquet(f"{tmp_path}/t")).collect()}
    for i, t in enumerate(texts):
        want = brute(t)
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest(), t
        assert got[i]["spans"] == ",".join(want)
        assert [got[i][f"n_{k}"] for k in PATTERNS] == [sum(s.startswith(k) for s in want) for k in PATTERNS]


def test_hard_spans(spark, tmp_path):
    check(spark, [
        "a@b.c_d@e.f x@@y.z a.@b.c.. @b.c a@b x@y.z@w.v", "1.2.3.4.5.6.7.8 256.1.1.1 0256.1.1.1 00255.1.1.1 1.1.1.1", "4111 1111 1111 1111 4111111111111111- 4111-1111 1111-1111, 411111111111111",
        "4111 1111 1111 1111 2", "+1 (017) 555-7713 +1 2 +12345678 +1234567 ++12345678- +123456789012345678", "😀😀 é x@y.z 😀 1.1.1.1", None, "", "a" * 30_000 + "@" + "b." * 3000 + "c " + "1" * 50_000 + " 1.1.1.1", "+" * 5000 + "1(((((",
        "x.y@z.w-" * 300, "@".join(["x"] * 500), "1-" * 5000 + "1", "7 " * 40,
    ], tmp_path)


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(alphabet="ab@.1290+-() 5é", max_size=60), min_size=30, max_size=60))
def test_any_text(spark, tmp_path, texts):
    check(spark, texts, tmp_path)


def corpus():
    rng = random.Random(1)
    vocabulary = ["".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(2000)]
    line = lambda n: " ".join(rng.choices(vocabulary, k=n))
    rows = [(i, line(60), "en", "s") for i in range(1500)]
    rows += [(2000 + i, f"{line(8)} Zebulon at zeb@corp.example.com {line(8)}", "en", "s") for i in range(5)]
    rows += [(3000, "Here zebulon sits, mail zebulon@x.org", "en", "s"), (3001, "nothing about ZEBULONS", "en", "s")]
    rows += [(4000 + i, f"{line(14)} once {i}@only.example.org", "en", "s") for i in range(20)]
    return rows


def test_terms_that_disclose_are_found_everywhere_and_others_left(spark, tmp_path):
    docs = documents(spark, tmp_path, corpus())
    got = {r["doc_id"]: r["spans"].split(",") if r["spans"] else [] for r in pii.find(docs).collect()}
    text = {r[0]: r[1] for r in corpus()}
    for i in range(2000, 2005):
        at = text[i].index("Zebulon")
        assert f"removed:{at}:{at + 7}" in got[i]
    assert "removed:5:12" in got[3000] and "email:24:37" in got[3000] and not any(s.startswith("removed:24") for s in got[3000])
    assert got[3001] == [] and all(got[i] == [] for i in range(1500))
    assert all(len(got[4000 + i]) == 1 for i in range(20))


def test_sanitised_texts(spark, tmp_path):
    docs = documents(spark, tmp_path, corpus())
    out = pii.sanitise(docs)
    assert out.columns == docs.columns
    got = {r["doc_id"]: r for r in out.collect()}
    before = {r["doc_id"]: r for r in docs.collect()}
    assert got[3000]["text"] == "Here  sits, mail [EMAIL]" and got[3000]["n_chars"] == 24
    assert "@" not in "".join(r["text"] for r in got.values())
    assert all(got[i] == before[i] for i in range(1500))


def test_terms_are_found_in_documents_without_values(spark, tmp_path):
    import corpus_pipeline

    from proofyard.llm import registry

    rows = [*corpus(), (3002, "Élise met zebulon, not Zebulonia", "en", "s"), (3003, None, "en", "s")]
    docs = documents(spark, tmp_path, rows)
    docs.write.parquet(f"{tmp_path}/sf/documents.parquet")
    got = {r["doc_id"]: r for r in registry.op1_personal_data(spark, f"{tmp_path}/sf").collect()}
    assert len(got) == len(rows)
    assert got[3002]["spans"] == "removed:10:17" and got[3002]["n_terms"] == 1 and got[3002]["n_email"] == 0
    assert got[3000]["spans"] == "email:24:37,removed:5:12" and got[3003]["spans"] == got[3001]["spans"] == ""
    clean = {r["doc_id"]: r["text"] for r in corpus_pipeline.sanitise(spark, spark.read.parquet(f"{tmp_path}/sf/documents.parquet"), f"{tmp_path}/sf").collect()}
    assert clean[3002] == "Élise met , not Zebulonia" and clean[3000] == "Here  sits, mail [EMAIL]" and clean[3003] is None
    assert all(clean[r[0]] == r[1] for r in rows[:1500])


def test_odd_rows(spark, tmp_path):
    docs = documents(spark, tmp_path)
    assert pii.find(docs).count() == len(ROWS)
    assert sorted(map(str, pii.sanitise(docs).collect())) == sorted(map(str, docs.collect()))
    empty = docs.limit(0)
    assert pii.find(empty).count() == pii.sanitise(empty).count() == 0


def brute_terms(rows):
    """Terms that disclose, with the class each is generalised to (None: removed), by counting in memory."""
    import math

    n, about, held, classes = len(rows), {}, {}, {}
    for i, (_, text, *_) in enumerate(rows):
        words = set(re.findall(r"[^\W\d_]{3,}", (text or "").lower()))
        for w in words:
            held.setdefault(w, set()).add(i)
            for k in pii.PREFIXES:
                classes.setdefault(w[:k], set()).add(i)
        for kind, p in PATTERNS.items():
            for m in re.finditer(p, text or ""):
                if valid(kind, m.group()):
                    a, b = max(0, m.start() - pii.WINDOW), m.end() + pii.WINDOW
                    before, after = text[a : m.start()], text[m.end() : b]
                    before = re.sub(r"^[^\W\d_]+", "", before) if len(before) == pii.WINDOW else before
                    after = re.sub(r"[^\W\d_]+$", "", after) if len(after) == pii.WINDOW else after
                    entry = about.setdefault((kind, m.group().lower()), {}).setdefault(i, set())
                    entry |= set(re.findall(r"[^\W\d_]{3,}", (before + " " + after).lower()))
    about = {e: d for e, d in about.items() if pii.SUPPORT <= len(d) < n}
    pairs = {(e, t): sum(t in x for x in d.values()) for e, d in about.items() for t in set().union(*d.values())}
    told = {}
    for (e, t), together in pairs.items():
        if together < pii.SUPPORT:
            continue
        share = lambda docs: math.log(together * n / (len(about[e]) * docs)) / math.log(n / len(about[e]))  # noqa: B023, E731
        if share(len(held[t])) < pii.GENERALISE or together * math.log(together * n / (len(about[e]) * len(held[t]))) < math.log(len(pairs)):
            continue
        wide = [t[:k] for k in pii.PREFIXES if share(max(together, len(classes[t[:k]]))) < pii.GENERALISE]
        told.setdefault(t, []).append(None if share(len(held[t])) >= pii.REMOVE or not wide else max(wide, key=len))
    return {t: None if None in c else min(c, key=len) for t, c in told.items()}


def test_terms_against_counts_in_memory(spark, tmp_path):
    rng = random.Random(12)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(3, 8))) for _ in range(7000)]
    line = lambda n: " ".join(rng.choices(vocabulary, k=n))
    rows = [(i, line(50), "en", "s") for i in range(700)]
    for i in range(12):  # documents with an entity, in copies
        text = f"{line(30)} {line(9)} mail p{i}@corp.example.com or 10.0.0.{i} {line(40)}"
        rows += [(1000 + 10 * i + j, text, "en", "s") for j in range(2 + i % 4)]
    rows += [(5000 + i, f"{line(25)} p{i % 3}@corp.example.com {line(25)}", "en", "s") for i in range(9)]
    rows += [(6000, None, "en", "s"), (6001, "x@y.zz " + " ".join(vocabulary[:300]), "en", "s")]
    told = brute_terms(rows)
    assert len(told) > 20 and None in told.values() and any(told.values())
    docs = documents(spark, tmp_path, rows)
    got = {r["doc_id"]: r for r in pii.find(docs).collect()}
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(docs).collect()}
    for i, text, *_ in rows:
        want = brute(text)
        if want:
            base = [tuple(map(int, s.split(":")[1:])) for s in want]
            for kind in ("removed", "generalised"):
                want += [f"{kind}:{m.start()}:{m.end()}" for m in re.finditer(r"[^\W\d_]+", text) if m.group().lower() in told and (told[m.group().lower()] is None) == (kind == "removed")
                         and not any(a < m.end() and m.start() < b for a, b in base)]
        assert got[i]["spans"] == ",".join(want), i
        if want:
            for m in re.finditer(r"[^\W\d_]+", text):
                if told.get(m.group().lower()):
                    assert f"[{told[m.group().lower()]}*]" in clean[i], (m.group(), told[m.group().lower()], [x for x in re.findall(r"\[[^\]]*\]", clean[i])], got[i]["spans"])
        else:
            assert clean[i] == text
