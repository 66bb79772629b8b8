"""Operators against plain Python on the smallest tables, on hard rows, and by held-out accuracy."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagewright.llm import attention, chat, common, decontaminate, langid, lm, mixing, pii, quality_model, quality_rules, queries, secrets, spans

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


# --- spans of secrets and personal data ---

BASE = [
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), lambda m: len(m[2]) >= 8),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 16), ("hex", re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 32),
]
DIGITS = lambda m: re.sub("[^0-9]", "", m[0])
LUHN = lambda d: sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
PRIVATE = [
    ("email", re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), lambda m: True), ("ip", re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), lambda m: all(int(p) <= 255 for p in m[0].split("."))),
    ("card", re.compile(r"[0-9]([\x20-]?[0-9])+"), lambda m: 12 <= len(DIGITS(m)) <= 19 and LUHN(DIGITS(m))), ("phone", re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"), lambda m: 9 <= len(DIGITS(m)) <= 15),
]


def plain(text, patterns):
    kinds = [k for k, _, _ in patterns]
    found = [(k, *m.span()) for k, rx, fits in patterns for m in rx.finditer(text or "") if fits(m)]
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(found, key=lambda x: (x[1], kinds.index(x[0]))))


def noise(rng):
    bits = ["a@b.c@d.e", "1.2.3.4.5", "300.1.1.1", "0001.2.3.4", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (988) 555-2485", "+12345", "++1((((", "token: secret: abcdefgh", 'API_KEY"= "abc.defghij"', "tOKEN=Kabcdefgh", "paſsword=abcdefgh",
            "AKIA" + "Z" * 12, "AKIAAKIAAKIA1234", "0" * 31, "f" * 33, "x@-.-", "é@é.com", "..@..", "a..b@c-d.e-f", "1 2-3", " ", "\n", "=", "secret=", "password==abcdefgh", "9" * 25]
    return "".join(rng.choice(bits) + rng.choice(["", " ", ",", "-"]) for _ in range(rng.randint(1, 12)))


def test_base_spans():
    rng = random.Random(1)
    for text in ["", None, *[noise(rng) for _ in range(3000)]]:
        t = text or ""
        assert spans.in_order(spans.secret_spans(t), secrets.KINDS) == plain(text, BASE)
        assert spans.in_order(spans.private_spans(t), pii.KINDS) == plain(text, PRIVATE)


def test_long_runs_take_linear_time():
    for text in ("a" * 300_000 + "@", "1" * 300_000, "+1(" * 100_000, "f" * 300_000, "1." * 150_000, "AKIA" * 70_000, "a@" * 150_000):
        spans.secret_spans(text)
        spans.private_spans(text)
    for text in ("x" * 300_000 + "1x1 1234567", "1" * 300_000 + " x", "a1" * 150_000, "@" * 300_000, "(" * 300_000 + "1"):
        list(pii.tuples(text))
    for text in ("\\" * 300_000, "\\" * 300_000 + "</s>", "<|" * 150_000):
        assert chat.unescape(chat.escape(text)) == text
    secrets.random_spans("aB3" * 100_000 + "é", [], np.zeros((secrets.ENDS + 1,) * 2), 1.0)


@pytest.mark.parametrize(("query", "patterns"), [(queries.op1_secret_scan, BASE), (queries.op7_pii, PRIVATE)])
def test_span_queries(spark, documents, query, patterns):
    want = {r.doc_id: plain(r.text, patterns) for r in documents.collect()}
    got = query(spark, SF).collect()
    assert {r.doc_id: r.base_sha256 for r in got} == {i: hashlib.sha256(b.encode()).hexdigest() for i, b in want.items()}
    assert all(set(filter(None, want[r.doc_id].split(","))) <= set(r.spans.split(",")) for r in got)


def test_random_strings_are_told_from_identifiers(spark, documents):
    table, threshold = secrets.train(secrets.labelled_samples(documents, 4_000, 100))
    rng = random.Random(99)
    caught = sum(secrets.ratio(table, v) > threshold for v in secrets.random_values(1000, rng))
    wrong = sum(secrets.ratio(table, v) > threshold for v in secrets.ordinary_values(["anthe", "quest", "louer", "value", "index"], 1000, rng))
    assert caught > 950 and wrong <= 5
    found = secrets.scan("see kJ8sQ2vLx0Zp7RtB4nWm and getUserNameFromIndex", table, threshold)
    assert found["spans"] == "random:4:24"


def test_masking(spark):
    docs = spark.createDataFrame([(1, "a password=abcdefgh1 b"), (2, None), (3, "nothing")], "doc_id long, text string")
    assert [r.text for r in secrets.masked(secrets.find_secrets(docs)).orderBy("doc_id").collect()] == ["a <SECRET> b", None, "nothing"]


def test_patterns_find_unseen_identifiers(spark):
    rng = random.Random(4)
    cards = ["4111111111111111", "5500005555555559", "4012888888881881", "378282246310005", "6011111111111117", "5105105105105100"]
    rows = [(i, f"words and more, account: {c} then") for i, c in enumerate(cards * 3)]
    rows += [(100 + i, f"other text here, account: {rng.randrange(10**15, 10**16)} then") for i in range(3)] + [(200, "just 1234567890123456 then"), (201, "and then more, then less " * 50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.row.doc_id: r.found.spans for r in pii.find_private(docs).collect()}
    assert all("context:" in got[100 + i] or "card:" in got[100 + i] for i in range(3)) and "context" not in got[200]


def test_trust_passes_to_other_shapes(spark):
    rows = [(i, f"the customer account: a{i}b@mail.example.com is known") for i in range(40)] + [(100 + i, f"the customer account: AB{1234567 + i} is known") for i in range(8)]
    rows += [(200 + i, f"some number {70_000 + i} of many") for i in range(40)]
    got = {r.row.doc_id: r.found.spans for r in pii.find_private(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[100 + i] == "context:22:31" for i in range(8)) and not any(got[200 + i] for i in range(40))


def test_no_sure_pattern_is_left_out(spark):
    names = ["".join(chr(97 + i // 26**k % 26) for k in range(3)) for i in range(12_000)]
    patterns = spark.createDataFrame([(f"L x{n}: 9", 0.9) for n in names], "pattern string, confidence double")
    docs = spark.createDataFrame([*enumerate([f"so x{n}: 1234567" for n in names[::1000]]), (99, "so other: 1234567"), (None, None)], "doc_id long, text string")
    want = {(None, ""), (99, ""), *((i, "context:9:16") for i in range(12))}
    learnt = spark.createDataFrame([(i, " ".join(f"x{n}: a{k}{n}@mail.com" for k in range(5))) for i, n in enumerate(names[:10_050])], "doc_id long, text string")
    assert pii.learn_patterns(learnt).count() >= 10_050
    for most in (5, 20_000):
        assert {(r.row.doc_id, r.found.spans) for r in pii.find_private(docs, patterns, most_shared=most).collect()} == want


# --- chat ---


def test_escapes_are_reversible():
    rng = random.Random(2)
    for _ in range(2000):
        text = "".join(rng.choice(["\\", "<|end|>", "<|text|>", "</s>", "[INST]", "a", "<", "|>", "[/INST]"]) for _ in range(rng.randint(0, 9)))
        escaped = chat.escape(text)
        assert chat.unescape(escaped) == text
        assert all(m[1] for m in chat.ESCAPED.finditer(escaped))


@pytest.mark.parametrize("most", [chat.MOST_IDS, 5])
def test_conversations_come_back(spark, most):
    rows = [(1, 1, "assistant", "b</s>"), (1, 0, "user", None), (1, 2, None, "x"), (1, 3, "tool<|text|>", "<|assistant|><|text|>no"), (2, 0, "assistant", "é 漢字 🙂" * 3000), (2, 0, "assistant", "tie"), (None, None, "assistant", "z")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("ids", F.lit(1))
    got = {r.conv_id: r for r in chat.read_back(chat.assembled(chat.format_turns(df), most_ids=most)).collect()}
    assert set(got) == {1, 2, None}
    for conv, r in got.items():
        own = sorted([x for x in rows if x[0] == conv], key=lambda x: (x[1] is not None, x[1] or 0, x[2] or "", x[3] or ""))
        loss = "".join(x[3] or "" for x in own if x[2] == "assistant")
        assert r.n_turns == len(own) and r.loss_chars == len(loss) and r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert r.turns_sha256 == hashlib.sha256("".join(f"{x[2] or ''}\n{x[3] or ''}\n" for x in own).encode()).hexdigest()
    assert chat.read_back(chat.assembled(chat.format_turns(spark.createDataFrame([], df.schema)))).count() == 0


def test_ids_are_the_tokenizers_at_every_length(spark):
    encoder, rng = chat.tokenizer(chat.default_path()), random.Random(3)
    text = lambda n: "".join(rng.choice(["word ", "two\n", " \n\n ", "x1", "é漢", "  "]) for _ in range(n))
    for t in [*(text(n) for n in (10, 2_000, 30_000)), "x" * 50_000, "1" * 9_000]:
        assert chat.encode(t, encoder) == encoder.encode_ordinary(t)
    for run in (" " * 300, "\n " * 200, "\u3000" * 700):
        for t in (run, "a" + run, run + "b", "a" + run + "b" + run + " c", f"a{run}1{run}"):
            assert chat.encode(t, encoder) == encoder.encode_ordinary(t)
    assert encoder.decode_bytes(chat.encode("a" + " " * 400_000 + "b", encoder)).decode() == "a" + " " * 400_000 + "b"


def test_one_list_of_ids_for_each_conversation(spark):
    rows = [(c, t, ["system", "user", "assistant", "tool"][(c + t) % 4], "text " * (t + 1)) for c in range(6) for t in range(5)]
    encoder = chat.tokenizer(chat.default_path())
    at, by_part = chat.first_mark(encoder), {}
    formatted = chat.format_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    whole = {r.conv_id: (r.ids, r.mask) for r in chat.assembled(formatted).collect()}
    for r in sorted(chat.assembled(formatted, most_ids=12).collect(), key=lambda r: (r.conv_id, r.part)):
        ids, mask = by_part.setdefault(r.conv_id, ([], []))
        ids += r.ids
        mask += r.mask
    assert whole == by_part and len(whole) == 6
    for c, (ids, mask) in whole.items():
        want, learnt = [at], [False]
        for _, _, role, text in rows[5 * c : 5 * c + 5]:
            head = [at + chat.ROLES[role]] if role in chat.ROLES else [at + chat.OTHER, *encoder.encode_ordinary(role)]
            own = encoder.encode_ordinary(text)
            want += [*head, at + chat.TEXT, *own, at + chat.END]
            learnt += [False] * (len(head) + 1) + [role == "assistant"] * len(own) + [False]
        assert ids == want and mask == learnt


# --- rules, decontamination, mixing ---


def plain_rules(text):
    words = WORD.findall(text or "")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    n = Counter(windows)
    hit = {i + k for i, w in enumerate(windows) if n[w] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(hit)


def test_rules(spark, documents, clashing):
    docs = documents.select("doc_id", "text", "lang", "source").unionByName(clashing.select("doc_id", "text", "lang", "source").where("doc_id is not null"))
    want = {}
    for r in docs.collect():
        want[r.doc_id] = plain_rules(r.text)
    docs = docs.where("doc_id >= 0")
    for r in quality_rules.quality_rules(docs).collect():
        if r.row.doc_id > 8:  # ids of both tables
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want[r.row.doc_id]
            assert not (r.kept and r.base_failed) and r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)


def test_rules_on_hard_rows(hard, clashing, empty):
    for r in quality_rules.quality_rules(clashing).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == plain_rules(r.row.text) and r.row.asDict()["kept"] == 6
    assert quality_rules.quality_rules(empty).count() == 0


def plain_kept(rows):
    """Verdicts of (text, lang, source) rows by sorted lists of logarithms."""
    counts = [plain_rules(t) for t, *_ in rows]
    n_lines = [sum(1 for x in (t or "").split("\n") if WORD.search(x)) for t, *_ in rows]
    values = [{k: math.floor(math.log(v) * 100) for k, v in {"symbols": (s + 1) / (n + 1), "dup_lines": (d + 1) / (ln + 1), "repeats": (r + 1) / (n + 1), "chars_per_word": max(c, 1) / max(n, 1)}.items()} for (n, c, s, d, r), ln in zip(counts, n_lines)]
    fine = [n >= 50 and 100 * r <= 50 * n for n, *_, r in counts]
    levels = [(lambda x: x[1:], 1), (lambda x: x[1], 1), (lambda x: None, 0)]

    def quartile(i, m, level, q):
        own = sorted(v[m] for v, ok, row in zip(values, fine, rows) if ok and levels[level][0](row) == levels[level][0](rows[i]))
        return len(own), own[-(-len(own) * q // 4) - 1]

    out = []
    for i, ok in enumerate(fine):
        for m, (reach, least) in quality_rules.MEASURES.items():
            if not ok:
                break
            ends = []
            for q in (1, 3):
                at = None
                for level in (2, 1, 0):
                    n, own = quartile(i, m, level, q)
                    at = own if at is None else (n * own + quality_rules.HALF_WEIGHT * at) / (n + quality_rules.HALF_WEIGHT)
                ends.append(at)
            width = max(ends[1] - ends[0], least) * reach
            ok = values[i][m] <= ends[1] + width and (m in quality_rules.ONE_SIDED or values[i][m] >= ends[0] - width)
        out.append(ok)
    return out


def test_verdicts_against_plain_python_and_partitionings(spark, documents):
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randint(2, 9)))
    rows = [(r.text, r.lang, r.source) for r in documents.collect()]
    rows += [(" ".join(word() + ("|" if rng.random() < 0.4 else "") for _ in range(60)), "en", f"src{i % 3}") for i in range(30)] + [("x" * 900 + " y" * 60, None, None), (" ".join(["a b c d e f g h i j k l"] * 4) + " z" * 60, None, None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string")
    want = dict(enumerate(plain_kept(rows)))
    assert 10 < sum(not k for k in want.values()) < len(rows) // 2
    for dealt in (df, df.repartition(7), df.coalesce(1)):
        assert {r.row.doc_id: r.kept for r in quality_rules.quality_rules(dealt).collect()} == want


def test_repeats_are_counted_alike_by_search_and_by_sort(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choices("abcdefghij"[: rng.randint(2, 10)], k=rng.randint(0, 300)))) for i in range(60)]
    df = spark.createDataFrame([(*r, "en", "s") for r in rows], "doc_id long, text string, lang string, source string")
    for few in (0, 5, 10**6):
        monkeypatch.setattr(quality_rules, "FEW_REPEATED", few)
        assert {r.row.doc_id: r.n_repeat_words for r in quality_rules.quality_rules(df).collect()} == {i: plain_rules(t)[4] for i, t in rows}


def test_rules_follow_their_group(spark):
    rng = random.Random(6)
    text = lambda extra: " ".join("".join(rng.choices("abcdefgh", k=5)) + ("|" if rng.random() < extra else "") for _ in range(80))
    rows = [(i, text(0.5), "en", "tables") for i in range(200)] + [(1000 + i, text(0.0), "en", "prose") for i in range(200)] + [(2000, text(0.9), "en", "prose")]
    limits = quality_rules.thresholds(rules_of(spark, rows)).collect()
    high = {r.source: r.high_symbols for r in limits}
    assert high["tables"] > high["prose"] + 50
    kept = {r.row.doc_id: r.kept for r in quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert sum(kept.values()) >= 400 and all(kept[i] for i in range(200))


def rules_of(spark, rows):
    rows = quality_rules.measured(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"))
    return rows.select("row.lang", "row.source", *[x.alias(m) for m, x in quality_rules.buckets_of().items()])


def test_good_labels_stay_and_bad_ones_go(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rows = quality_rules.quality_rules(docs).where("not base_failed").select("row.doc_id", "kept").join(labels, "doc_id").collect()
    good, bad = ([r.kept for r in rows if r.quality == q] for q in (1, 0))
    print("good kept", sum(good), "of", len(good), "bad kept", sum(bad), "of", len(bad))
    assert sum(good) >= 0.995 * len(good) and sum(bad) <= 0.02 * len(bad)


def plain_hits(text, items, size=10):
    words = decontaminate.words_of(text)
    hit, ids = set(), set()
    for item, t in items:
        for w in set(decontaminate.windows(decontaminate.words_of(t), size)):
            for i in range(len(words) - len(w) + 1):
                if tuple(words[i : i + len(w)]) == w:
                    hit |= set(range(i, i + len(w)))
                    ids.add(str(item))
    return len(words), len(hit), sorted(ids)


@pytest.mark.parametrize("shared", [10**5, 0])
def test_decontamination(spark, documents, clashing, shared, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", shared)
    monkeypatch.setattr(common, "BROADCAST_ROWS", shared)
    items = spark.read.parquet(f"{SF}/benchmark.parquet").unionByName(spark.createDataFrame([(-1, "Lonely WORDS without"), (-2, None), (None, "one two three"), (-3, " .. "), (-4, "word word")], "item_id long, text string"))
    plain_items = [(r.item_id, r.text) for r in items.collect() if r.item_id is not None and r.text]
    docs = documents.select("doc_id", "text").limit(60).unionByName(clashing.select("doc_id", "text").where("doc_id <> 7 or doc_id is null"))
    rows = decontaminate.decontaminate(docs, items).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert (r.n_words, r.n_hit, list(r.items)) == plain_hits(r.row.text, plain_items) and r.contaminated == (r.n_hit > 0)


def test_decontamination_of_long_and_no_rows(spark, hard, empty):
    items = spark.createDataFrame([(1, "word " * 12)], "item_id long, text string")
    got = {r.row.doc_id: r.n_hit for r in decontaminate.decontaminate(hard, items).collect()}
    assert got[7] == 30_000 and got[4] == 0
    assert decontaminate.decontaminate(empty, items).count() == 0
    assert not any(r.contaminated for r in decontaminate.decontaminate(hard, items.where("false")).collect())


def test_windows_that_overlap_repeat_and_share_words(spark):
    rng = random.Random(17)
    text = lambda n: " ".join(rng.choice("abc") for _ in range(n))
    items = [(i % 25, text(rng.choice([1, 3, 9, 10, 11, 25]))) for i in range(30)]
    rows = [(i, text(rng.randint(0, 60))) for i in range(150)] + [(1000 + i, f"zz {items[3][1]} yy") for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for r in decontaminate.decontaminate(docs, spark.createDataFrame(items, "item_id long, text string")).collect():
        assert (r.n_words, r.n_hit, list(r.items)) == plain_hits(r.row.text, items)


def test_mixing(spark, documents, clashing, empty):
    docs = documents.select("doc_id", "text", "source").unionByName(clashing.select("doc_id", "text", "source"))
    rows = mixing.mix(docs).collect()
    total = sum(r.size for r in rows)
    by = {}
    for r in rows:
        by.setdefault(r.row.source, []).append(r)
        assert 0 <= r.taken <= 2 * r.size and r.size == len(WORD.findall(r.row.text or ""))
    order = sorted(by, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    size = {s: sum(r.size for r in own) for s, own in by.items()}
    target, free = dict.fromkeys(order, 0.0), set(order)
    rest = 1.5 * total
    while rest > 1e-6 and free:
        share = {s: rest * weight[s] / sum(weight[f] for f in free) for s in free}
        rest = 0.0
        for s in list(free):
            target[s] += share[s]
            if target[s] >= 2 * size[s]:
                rest += target[s] - 2 * size[s]
                target[s] = 2.0 * size[s]
                free.discard(s)
    for s, own in by.items():
        assert math.isclose(own[0].target, target[s], rel_tol=1e-9, abs_tol=1e-6)
        assert abs(sum(r.taken for r in own) - target[s]) <= 3
    again = {(r.row.doc_id, r.row.text): r.taken for r in mixing.mix(docs.repartition(7)).collect()}
    assert again == {(r.row.doc_id, r.row.text): r.taken for r in rows}
    assert sum(r.mix_words for r in mixing.epochs(mixing.mix(docs)).collect()) == sum(r.taken for r in rows)
    assert mixing.mix(empty).count() == 0 and mixing.mix(clashing).count() == clashing.count()


# --- models ---


def test_language_ids(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = langid.identify(docs).where(langid.held_out(F.col("row.doc_id"))).collect()
    assert all(zlib.crc32(str(r.row.doc_id).encode()) % 4 == 2 for r in rows)
    assert sum(r.found.lang_pred == r.row.lang for r in rows) / len(rows) > 0.97


def test_languages_against_plain_sizes(spark, documents):
    """Predictions by compressing pieces with dictionaries, one after another."""
    import zstandard

    contents = langid.excerpts(documents)
    found = {r.row.doc_id: r.found for r in langid.identify(documents).collect()}
    for r in documents.collect():
        data, size = (r.text or "").lower().encode(), {}
        for lang, content in contents.items():
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            size[lang] = sum(len(zstandard.ZstdCompressor(level=langid.LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False).compress(data[i : i + langid.PIECE])) for i in range(0, len(data), langid.PIECE))
        if not any(c.isalpha() for c in r.text or ""):
            assert found[r.doc_id].lang_pred == "und"
            continue
        best = min(sorted(size), key=size.__getitem__)
        margin = 1 - size[best] / sorted(size.values())[1]
        assert found[r.doc_id].lang_pred == best and math.isclose(found[r.doc_id].score, margin / (margin + langid.MIN_MARGIN)) and found[r.doc_id].rejected == (margin < langid.MIN_MARGIN)


def test_excerpts_come_from_rows_that_are_not_held_out(spark, documents):
    own = [r for r in documents.collect() if r.lang and r.text and zlib.crc32(str(r.doc_id).encode()) % 4 != 2]
    for lang, content in langid.excerpts(documents).items():
        texts = "\n".join(r.text.lower() for r in own if r.lang == lang)
        pieces = content.decode().rstrip("\n")
        assert pieces[:200] in texts and 0 < len(content) < 6 * langid.EXCERPTS * (langid.EXCERPT_CHARS + 1)


def test_language_ids_of_hard_rows(spark, documents, clashing, empty):
    got = {r.row.doc_id: r.found for r in langid.identify(clashing, documents).collect()}
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (1, 2, 3)) and all(0 <= x.score <= 1 for x in got.values())
    assert langid.identify(empty).count() == 0 and {r.found.lang_pred for r in langid.identify(clashing, empty).collect()} == {"und"}


def test_quality_model(spark, clashing, empty):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = quality_model.classify(docs, labels.where("doc_id % 2 = 0")).select("row.doc_id", "found.*").join(labels.where("doc_id % 2 = 1"), "doc_id").collect()
    assert sum(r.kept == (r.quality == 1) for r in rows) / len(rows) > 0.97 and all(0 <= r.score <= 1 for r in rows)
    some = spark.createDataFrame([(4, 1, 0), (7, 0, 0), (8, None, 0), (5, 1, 0), (5, 0, 1)], "doc_id long, quality int, toxic int")
    assert quality_model.classify(clashing, some).count() == clashing.count() and quality_model.classify(empty, some).count() == 0
    again = {str(r.row.doc_id) + str(r.row.text): r.found for r in quality_model.classify(clashing, some).collect()}
    assert all(again[str(r.row.doc_id) + str(r.row.text)] == r.found for r in quality_model.classify(clashing.repartition(3), some).collect())


def test_quality_without_both_classes_is_the_prior(spark, hard):
    for labels, want in ([], 0.5), ([(4, 1), (7, 1), (999, 0)], 0.75), ([(4, 0)], 1 / 3):
        found = quality_model.classify(hard, spark.createDataFrame(labels, "doc_id long, quality int")).select("found.*").collect()
        assert len(found) == hard.count() and all(math.isclose(x, want, rel_tol=1e-9) for r in found for x in (r.score, r.score_text, r.score_meta))


def test_rounds_against_all_rows_in_memory(spark):
    """The rounds with a plain search of all rows in memory give the same model."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    views = docs.unionByName(docs.limit(50)).select("doc_id", *quality_model.VIEWS)
    known, good, bad = quality_model.labelled_sample(views, labels.where("doc_id % 3 = 0"))
    assert good and bad and len(known.y) <= good + bad
    everything = quality_model.on_driver(views.select(quality_model.view_mark(), F.lit(None).cast("double").alias("y"), *quality_model.VIEWS))
    picked = []

    def pick(model, most, taken):
        z = [a * quality_model.logits(x.astype(np.float64), w) + b for x, w, (a, b) in ((everything.text, model.text, model.text_scale), (everything.meta, model.meta, model.meta_scale))]
        out = []
        for sure, n in zip((z[0], -z[0], z[1], -z[1]), most):
            order = [i for i in np.lexsort((everything.mark, -sure)) if sure[i] >= math.log(19) and int(everything.mark[i]) not in taken][:n]
            out.append(quality_model.Rows(everything.text[order], everything.meta[order], everything.y[order], everything.mark[order]))
        picked.append([set(r.mark.tolist()) for r in out])
        return out

    plain, spread = [], quality_model.pick_from(views)

    def both(model, most, taken):
        found = spread(model, most, taken)
        plain.append([set(r.mark.tolist()) for r in found])
        pick(model, most, taken)
        return found

    quality_model.co_train(known, both, rounds=2, handed=40)
    assert sum(map(len, plain[0])) > 20
    for a, b in zip(plain, picked):
        for x, y in zip(a, b):
            assert len(x) == len(y) and len(x ^ y) <= 2  # sums in another order may swap what is equally sure


def test_attention_gradients():
    rng = np.random.default_rng(0)
    w = {k: v.astype(np.float64) for k, v in attention.first_weights(np.arange(attention.HEAD)[::-1] + 1, 5.0).items()}
    x, t, _ = attention.windows([rng.integers(0, attention.HEAD + 1, n).astype(np.int32) for n in (5, 40, 17)])
    loss, g = attention.gradients(w, x, t)
    goal = next(z for z in t[0] if 0 <= z < attention.HEAD)
    for k in w:
        at = {"E": (x[0, attention.CHUNK + 1], 3), "O": (goal // attention.IN_CLASS, 2, goal % attention.IN_CLASS)}.get(k, tuple(s // 3 for s in w[k].shape))
        ends = []
        for step in (1e-5, -2e-5):
            w[k][at] += step
            ends.append(attention.gradients(w, x, t)[0])
        w[k][at] += 1e-5
        assert math.isclose((ends[0] - ends[1]) / 2e-5, g[k][at], rel_tol=1e-3, abs_tol=1e-6)
    single = {k: v.astype(np.float32) for k, v in w.items()}
    assert math.isclose(loss, -attention.Scorer(single).log_probs(x, t).sum(), rel_tol=1e-4)


def test_attention_is_a_distribution_and_causal():
    w = attention.first_weights(np.arange(attention.HEAD) + 1.0, 9.0)
    s = attention.Scorer(w)
    codes = np.arange(40, dtype=np.int32)
    x, t, _ = attention.windows([codes])
    assert (t >= 0).sum() == len(codes)
    each = np.tile(x[:1], (attention.HEAD + 1, 1)), np.full((attention.HEAD + 1, attention.CHUNK), -1, np.int32)
    each[1][:, 7] = np.arange(attention.HEAD + 1)
    assert math.isclose(np.exp(s.log_probs(*each)[:, 7].astype(float)).sum(), 1, rel_tol=1e-4)
    ahead = x.copy()
    ahead[:, -1] = 5
    assert np.allclose(s.log_probs(x, t)[:, :-1], s.log_probs(ahead, t)[:, :-1])


@pytest.mark.parametrize("shared", [10**6, 50])
def test_lm_scores(spark, documents, clashing, shared):
    docs = documents.select("doc_id", "text").unionByName(clashing.select("doc_id", "text"))
    rows = docs.collect()
    tokens = lambda t: [*(t or "").encode().lower().split(), b""]
    held = lambda i: zlib.crc32(str("" if i is None else i).encode()) % 7 == 2
    counts = Counter(w for r in rows if not held(r.doc_id) for w in tokens(r.text))
    n, v = counts.total(), len(counts)
    want = sorted((str(r.doc_id), held(r.doc_id), len(tokens(r.text)), sum(counts[w] > 0 for w in tokens(r.text)), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens(r.text)), 6)) for r in rows)
    got = lm.score_documents(docs, most_shared=shared, rates=(0.01,)).collect()
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)
    assert lm.score_documents(docs.where("false")).count() == 0


def plain_log10(w, codes, tail):
    """log10 of the probability of a text's ids, position by position, by the model's definition in doubles."""
    n, total = attention.CHUNK, 0.0
    inputs = [attention.START, *codes[:-1].tolist()]
    for i, goal in enumerate(codes.tolist()):
        seen = range(max(0, (i // n - 1) * n), i + 1)
        q = w["E"][inputs[i]] @ w["Q"] / math.sqrt(attention.WIDTH)
        s = np.array([q @ (w["E"][inputs[j]] @ w["K"]) + w["r"][i - j] for j in seen])
        p = np.exp(s - s.max())
        h = w["E"][inputs[i]] + sum(x * (w["E"][inputs[j]] @ w["V"]) for x, j in zip(p / p.sum(), seen))
        h = h + np.maximum(h @ w["A"] + w["a"], 0) @ w["B"]
        kind = min(goal // attention.IN_CLASS, attention.CLASSES)
        z = h @ w["U"] + w["u"]
        total += z[kind] - np.log(np.exp(z).sum())
        if kind < attention.CLASSES:
            y = h @ w["O"][kind] + w["o"][kind]
            total += y[goal % attention.IN_CLASS] - np.log(np.exp(y).sum())
        else:
            total += tail[i]
    return total / math.log(10)


def test_scores_against_a_plain_model(spark, documents):
    docs = documents.select("doc_id", "text").where("doc_id < 40 and length(text) < 3000")
    path = chat.default_path()
    training = docs.where(~lm.held_out(F.col("doc_id")))
    counts = lm.id_counts(lm.word_counts(training), path)
    w = {k: v.astype(np.float64) for k, v in lm.train_model(training, counts, path, (0.01, 0.005)).items()}
    again = {k: v.astype(np.float64) for k, v in lm.train_model(training.repartition(5), counts, path, (0.01, 0.005)).items()}
    assert all((w[k] == again[k]).all() for k in w)  # the same digits whatever the partitions
    codes, tail = lm.code_table(counts)
    got = {r.doc_id: r.score for r in lm.score_documents(docs, rates=(0.01, 0.005)).collect()}
    encoder = chat.tokenizer(path)
    for r in docs.collect():
        ids = np.array([i for x in (r.text or "").encode().lower().split() for i in encoder.encode_ordinary(" " + x.decode())] + [lm.END_ID])
        assert math.isclose(got[r.doc_id], plain_log10(w, codes[ids], np.where(np.isfinite(tail[ids]), tail[ids], 0.0)), rel_tol=1e-4)


def test_frequent_words_are_bounded(spark):
    words = spark.createDataFrame([(f"w{i}".encode(), 1 + i // 3) for i in range(300)], "word binary, n long")
    for most in (0, 5, 100, 1000):
        step = lm.least_shared(words, most)
        assert words.where(F.floor(F.log("n") * lm.STEPS) >= step).count() <= most
    assert lm.least_shared(words, 1000) <= 0 and lm.least_shared(words.where("false"), 5) == 1


def test_every_document_trains_the_attention_weights(spark, monkeypatch):
    monkeypatch.setattr(lm, "TASK_TOKENS", 10**12)
    counts = np.full(lm.VOCABULARY, 20_000)  # as of a corpus of a milliard ids
    codes, _ = lm.code_table(counts)
    by_code = np.bincount(codes, counts, minlength=lm.HEAD + 1)
    first = attention.flat(attention.first_weights(by_code[: lm.HEAD], by_code[lm.TAIL]))
    for i in range(2):
        doc = spark.createDataFrame([(i, f"a text of some words, number {i}")], "doc_id long, text string")
        assert not np.allclose(attention.flat(lm.train_model(doc, counts, chat.default_path(), rates=(0.01,))), first, atol=1e-4)


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet").collect()]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_duplicates", "decontamination", "secret_scan", "mixing"]
    good = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").where("quality = 1").select("doc_id")
    seen = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, seen, "/root/testdata/sf0.01").cache()
        assert out.columns == docs.columns
        if name == "quality_rules":
            long = [r.doc_id for r in seen.join(good, "doc_id").collect() if len(WORD.findall(r.text)) >= 50]
            assert len(set(long) - {r.doc_id for r in out.collect()}) <= 0.01 * len(long)
        if name == "near_duplicates":
            assert out.select("text").distinct().count() == out.count() and seen.select("text").distinct().count() - out.count() < 0.1 * seen.count()
        if name == "decontamination":
            left = {r.doc_id for r in out.collect()}
            assert all((r.doc_id in left) == (plain_hits(r.text, items)[1] == 0) for r in seen.limit(80).collect())
        if name == "secret_scan":
            assert not any(plain(r.text, BASE) for r in out.collect()) and out.count() == seen.count()
        seen = out
    mixed = corpus_pipeline.STAGES[-1][1](spark, seen, "/root/testdata/sf0.01")
    total = seen.select(F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")))).first()[0]
    assert abs(mixed.select(F.sum("mix_words")).first()[0] - 1.5 * total) < 100


def test_stages_on_hard_clashing_and_empty_tables(spark, hard, clashing, empty):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    for name, stage in corpus_pipeline.STAGES:
        plain, rows, none = (stage(spark, d, sf) for d in (hard, clashing, empty))
        columns = hard.columns if name != "mixing" else [*hard.columns, "mix_epoch", "mix_words"]
        text = lambda df: sorted((str(r.doc_id), str(r.text)) for r in df.collect())
        assert plain.columns == columns and set(clashing.columns) <= set(rows.columns) and none.columns == columns
        assert text(plain) == text(rows) and none.count() == 0
        if name != "mixing":
            assert rows.dtypes == clashing.dtypes and all(r.row == 0 and r.kept == 6 for r in rows.collect())
    by = {name: sorted(str(r.doc_id) for r in stage(spark, hard, sf).collect()) for name, stage in corpus_pipeline.STAGES}
    assert by["quality_rules"] == [] and by["near_duplicates"] == ["1", "4", "6", "7", "8", "None"]
    assert by["decontamination"] == by["secret_scan"] == sorted(str(r.doc_id) for r in hard.collect())


def test_run_leaves_only_the_last_table(spark, monkeypatch):
    import os

    import corpus_pipeline
    from pagewright.shared import shared_folder

    folder = shared_folder(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    rows = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert rows.count() and {x.rpartition("-")[0] for x in set(os.listdir(folder)) - before} == {"mixing"}
    assert common._scratch == []


def test_a_cluster_needs_a_shared_folder(monkeypatch):
    from types import SimpleNamespace

    from pagewright.shared import shared_folder

    given = {}
    for master, fine in (("local[4]", True), ("local", True), ("local-cluster[3,2,1000]", False), ("spark://host:7077", False), ("yarn", False)):
        sc = SimpleNamespace(master=master, getCheckpointDir=lambda: given.get("at"), setCheckpointDir=lambda x: given.update(at=x))
        given.clear()
        session = SimpleNamespace(sparkContext=sc, conf=SimpleNamespace(get=lambda key, default: default))
        if fine:
            assert shared_folder(session)
        else:
            with pytest.raises(ValueError):
                shared_folder(session)
