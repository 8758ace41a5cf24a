"""PII, secrets, quality, chat and the pipeline."""

import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarn.llm import chat, pii, quality, secrets
from tests.llm.conftest import prose

PATTERNS = (
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)


def plain_spans(text):
    out = []
    for kind, p in enumerate(PATTERNS):
        for m in re.finditer(p, text):
            digits = re.sub("[^0-9]", "", m[0])
            good = (
                True,
                kind != 1 or all(int(x) <= 255 for x in m[0].split(".")),
                kind != 2 or 14 <= len(digits) <= 19 and pii.luhn(digits),
                kind != 3 or 10 <= len(digits) <= 15,
            )
            if all(good):
                out.append((m.start(), kind, m.end()))
    return sorted(out)


def test_base_spans():
    rng = random.Random(4)
    alphabet = ["a", "Z", "9", "1", "255", "256", ".", "@", "+", "-", " ", "(", ")", "_", "%", "é", "\n", "4111111111111111"]
    cases = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(3000)]
    cases += ["a@b.c+d@e.f", "a@b.c.d@e.f", "x@y", "1.2.3.4.5.6.7.8", "+1 (020) 555-0142", "007.08.9.1", "4111 1111-1111 1111", "@@a@b.c"]
    for text in cases:
        assert pii.base_spans(text) == plain_spans(text), text
    assert pii.base_spans("9" * 30000) == [] and pii.base_spans("a@" * 5000) == []


@pytest.fixture(scope="module")
def field():
    return pii.train()


def test_field(field):
    def found(text):
        return [(pii.KINDS[k], text[a:b]) for a, k, b in pii.field_spans([text], [pii.base_spans(text)], field)[0]]

    assert found("please call (862) 555-1234, thanks") == [("phone", "(862) 555-1234")]
    assert found("or 862-555-9876.") == [("phone", "862-555-9876")]
    for clean in ("version 4.0 of 2020-11-30 at 12:45", "token = \"0f1e2d3c4b5a69788796a5b4c3d2e1f00f1e2d3c\"", "pages 10-20", "", "9" * 9000):
        assert found(clean) == []
    # Viterbi equals the best of all labellings.
    text = "at (862) 555-1234 9 of"
    (run, left, right), = pii.runs(text)
    tokens = [text[a:b] for a, b in run]
    u = field.potentials([pii.token_features(tokens, k, left, right) for k in range(len(tokens))])
    move = field.move + field.rule

    def total(s):
        return move[-1, s[0]] + u[0, s[0]] + sum(move[a, b] + u[i + 1, b] for i, (a, b) in enumerate(zip(s, s[1:])))

    best = max(itertools.product(range(pii.N_STATES), repeat=len(tokens)), key=total)
    got = field.viterbi([[pii.token_features(tokens, k, left, right) for k in range(len(tokens))]])[0]
    assert tuple(got) == best
    # It labels its own table right.
    for tokens, states, left, right in pii.labelled(pii.labelled_table()):
        got = field.viterbi([[pii.token_features(tokens, k, left, right) for k in range(len(tokens))]])[0]
        assert list(got) == states, tokens


def test_spans_of_the_field_can_be_values(field):
    for seed, n in ((100, 40), (5, 200), (7, 3000)):
        text = prose(seed, n)
        assert pii.field_spans([text], [pii.base_spans(text)], field) == [[]]
    text = "charge 4242 4242 4242 4241 5555 5555 5555 4444 again"
    run = [(m.start(), m.end()) for m in re.finditer(r"[0-9]+", text)]
    assert [text[a:b] for a, _, b in pii._values(text, 2, run)] == ["4242 4242 4242 4241", "5555 5555 5555 4444"]
    assert list(pii._values("a1 b2 c3 d4 e5 f6 g7 h8", 3, [(3 * k, 3 * k + 2) for k in range(8)])) == []
    assert pii.holds(3, "+1 (202) 555-0143") and not pii.holds(3, "river1 202 555 0143") and not pii.holds(2, "4242 4242")
    assert pii.holds(1, "192.0.2.7:80") and not pii.holds(1, "1.2.3") and not pii.holds(0, "a@b c")


def test_field_on_held_out_lines():
    for kind, (precision, recall, n) in pii.held_out_report().items():
        assert n >= 4 and precision >= 0.6 and recall >= 0.75, kind


def test_pii_of_odd_texts(spark, field):
    """Nulls, empty and very long texts, repeated rows and clashing names."""
    long_ = "x" * 300_000 + " a.b@example.org " + "9" * 300_000
    rows = [(1, None, "a"), (None, "", "b"), (2, long_, "c"), (2, long_, "c"), (3, "call (202) 555-0143", "d")]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string").withColumn("n_email", F.lit(7))
    got = sorted((r["doc_id"] or 0, r["n_email"], r["n_field"], r["spans"]) for r in pii.personal_data(df, field=field).collect())
    mail = f"email:300001:{300001 + len('a.b@example.org')}"
    assert got == [(0, 0, 0, ""), (1, 0, 0, ""), (2, 1, 0, mail), (2, 1, 0, mail), (3, 0, 1, "phone:5:19")]


def test_pii_rows(spark, docs, no_docs, field):
    found = pii.personal_data(docs, field=field)
    assert found.count() == docs.count() and {r["spans"] for r in found.collect()} == {""}
    assert pii.personal_data(no_docs, field=field).count() == 0
    one = spark.createDataFrame([(1, "Ä a.b@c.de and 1.2.3.4 or (862) 555-1234")], "doc_id long, text string")
    row = pii.personal_data(one, field=field).first()
    assert (row["n_email"], row["n_ip"], row["n_card"], row["n_phone"]) == (1, 1, 0, 0)
    assert row["base_spans"] == "email:2:10,ip:15:22" and row["spans"] == "email:2:10,ip:15:22,phone:26:40"


def test_secrets(spark, docs, no_docs):
    held = secrets.findings(300, seed=77)
    forest = secrets.train()
    x = np.array([secrets.features(t, b, a, secrets.dictionary()) for b, t, a, _ in held])
    y = np.array([r[3] for r in held])
    assert ((forest.score(x) >= 0.5) == y).mean() > 0.95
    rows = [
        (1, 'é so token = "d94a0c37be5182f6907e3b1c45a8d26f70e9b813" here'), (2, "commit d94a0c37be5182f6907e3b1c45a8d26f70e9b813"),
        (3, None), (4, ""), (5, "nothing to see in this text"), (6, "x" * 100), (1, "again"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r["doc_id"], r["text"]): (r["n_candidates"], r["n_secrets"], r["secret_spans"]) for r in secrets.secrets(df).collect()}
    assert got[1, rows[0][1]][:2] == (1, 1) and got[1, rows[0][1]][2].startswith("14:54:")
    assert got[2, rows[1][1]][:2] == (1, 0)
    assert all(got[r][:2] == (0, 0) for r in rows[2:])
    assert secrets.secrets(docs).count() == docs.count() and secrets.secrets(no_docs).count() == 0


def test_candidates_against_a_plain_twin():
    """Runs and named values, text by text, by patterns on strings."""
    import pyarrow as pa

    from tarn.llm.common import byte_view

    rng = random.Random(8)
    bits = ["token", "key", "=", " = ", ": ", '"', "'", "aB3dE6gH9jK2mN5pQ8", "abcdefghijklmnopqrst", "hunter2", " ", "\n", "bearer ", "x" * 30, "é", "A", "-", "/", "secret", "12345678"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(14))) for _ in range(600)] + [None, ""]
    data, offsets = byte_view(pa.array(texts))
    row, start, end = secrets.candidates(data, offsets)
    got = sorted(zip(row.tolist(), (start - offsets[row]).tolist(), (end - offsets[row]).tolist()))
    want = []
    for i, text in enumerate(texts):
        raw = (text or "").encode()
        runs = [m.span() for m in re.finditer(rb"[A-Za-z0-9_+/=.-]{16,}", raw)]
        runs = [s for s in runs if re.search(rb"[0-9]", raw[slice(*s)]) or re.search(rb"[A-Z]", raw[slice(*s)]) and re.search(rb"[a-z]", raw[slice(*s)])]
        values = []
        for m in secrets._NAMED.finditer(raw.lower()):
            a, b = m.span(m.lastindex)
            b = a + len(raw[a:b].rstrip(b".,:!?)")) if m.lastindex > 1 else b
            if b - a >= secrets.SHORT and not any(s < b and a < e for s, e in runs):
                values.append((a, b))
        want += [(i, *s) for s in runs + values]
    assert got == sorted(want) and len(got) > 100


def test_short_and_letter_only_secrets(spark):
    rows = [
        (1, 'é password = "hunter2-prod" end'), (2, "token = 'qwErtyuIopAsdfghJklzXcvb'"), (3, "x AbcDefQrsTuvWxyZaBcDeFgH y"),
        (4, "pwd=hunter2"), (5, '{"secret": "p@ß-w0rd!"}'), (6, "the password: required."), (7, "call getElementsByTagNameService"),
        (8, "my key is lost, the password forgotten"), (9, "api_key"), (10, '= "hunter2-prod"'), (11, "token = 'x1'"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = {r["doc_id"]: (r["n_candidates"], r["secret_spans"].rpartition(":")[0]) for r in secrets.secrets(df).collect()}
    assert got == {
        1: (1, "14:26"), 2: (1, "9:33"), 3: (1, "2:26"), 4: (1, "4:11"), 5: (1, "12:21"), 6: (1, ""), 7: (1, ""),
        8: (0, ""), 9: (0, ""), 10: (0, ""), 11: (0, ""),
    }


def _labelled(spark, n=160):
    docs, labels = [], []
    for i in range(n):
        text = prose(i, 30 + i % 40)
        if i % 3 == 0:
            text = text.upper() if i % 2 else " | ".join(text.split())
        docs.append((i, text, "en", "s", len(text)))
        labels.append((i, int(i % 3 != 0), 0))
    docs += [(1000, None, "en", "s", 0), (1001, "", None, None, 0), (1002, prose(7, 5000), "en", "s", 1)]
    labels += [(1000, 1, None), (None, 1, 0), (5, None, 0), (77777, 1, 1), (3, 0, 0)]
    return (
        spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long"),
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int"),
    )


def test_quality(spark, no_docs):
    docs, labels = _labelled(spark)
    model = quality.fit(docs, labels)
    rows = quality.scored(docs, model).withColumn("held", quality.held_out()).collect()
    assert len(rows) == docs.count() and all(0 <= r["quality_score"] <= 1 for r in rows)
    held = [r for r in rows if r["held"] and r["doc_id"] < 1000]
    right = [(r["quality_score"] >= quality.THRESHOLD) == (r["doc_id"] % 3 != 0) for r in held]
    assert len(held) > 15 and sum(right) / len(right) > 0.95
    again = {r["doc_id"]: r["quality_score"] for r in quality.scored(docs.repartition(5), quality.fit(docs.repartition(4), labels)).collect()}
    assert again == pytest.approx({r["doc_id"]: r["quality_score"] for r in rows}, abs=1e-5)
    assert quality.fit(docs, labels.limit(0)) is None
    assert {r[0] for r in quality.scored(docs, None).select("quality_score").collect()} == {0.5}
    assert quality.accepted(docs, labels).columns == docs.columns and quality.scored(no_docs, model).count() == 0


def test_passages_against_plain_counting():
    """Features and score of one text, passage by passage, without arrays over the batch."""
    import pyarrow as pa

    from tarn.llm.common import byte_view

    texts = ["", prose(3, 400), "é" * 300, None, "Short one."]
    x, first = quality.passage_features(*byte_view(pa.array(texts)))
    rng = np.random.default_rng(1)
    model = quality.AttentionMIL(hidden=5, gate=3)
    model.p = {k: rng.normal(0, 0.4, v.shape).astype(np.float32) for k, v in model.p.items()}
    scores = model.score(x, first)
    for i, text in enumerate(texts):
        raw = (text or "").encode()
        parts = [raw[k : k + 512] for k in range(0, len(raw), 512)] or [b""]
        mine = x[first[i] :][: len(parts)]
        for part, row in zip(parts, mine):
            ones, twos = np.zeros(130), np.zeros(quality.BIGRAMS)
            for c in part:
                ones[min(c, 128 if c < 192 else 129)] += 1
            for a, b in zip(part, part[1:]):
                twos[(a * 31 + b * 7 + (b >> 5)) % quality.BIGRAMS] += 1
            ones, twos = ones / max(1, len(part)), twos / max(1, len(part) - 1)
            more = [(ones**2).sum() * 4, (twos**2).sum() * 16, max(1, len(part)) / 512, ones[32] * 4]
            assert row == pytest.approx(np.concatenate([np.sqrt(ones), np.sqrt(twos), more]), abs=1e-5)
        p, h = model.p, np.tanh(mine @ model.p["W"] + model.p["b"])
        logit = (np.tanh(h @ p["V"]) / (1 + np.exp(-(h @ p["U"])))) @ p["w"]
        weight = np.exp(logit) / np.exp(logit).sum()
        want = 1 / (1 + np.exp(-((weight[:, None] * h).sum(axis=0) @ p["c"] + p["d"])))
        assert scores[i] == pytest.approx(float(want[0]), abs=1e-5)


def test_fit_sample_is_bounded_by_bytes(spark, monkeypatch):
    docs, labels = _labelled(spark)
    seen = []
    monkeypatch.setattr(quality.AttentionMIL, "fit", lambda self, x, first, y: seen.append((len(x), len(first))) or self)
    quality.fit(docs, labels)
    quality.fit(docs, labels, most_bytes=4000)
    assert 0 < seen[1][1] < seen[0][1] and seen[1][0] <= 4000 / 512 + seen[1][1]
    long_ = docs.where("doc_id = 1002").withColumn("doc_id", F.lit(1).cast("long"))
    quality.fit(long_, labels)
    assert seen[2] == (-(-len(prose(7, 5000)) // 512), 1)  # every passage
    # Too long documents are skipped wherever they come; of only such ones the shortest is taken.
    two = docs.where("doc_id < 60").unionByName(long_.withColumn("doc_id", F.lit(1).cast("long")))
    quality.fit(two, labels, most_bytes=6000)
    assert seen[3][1] > 1
    assert quality.fit(long_, labels, most_bytes=100) is not None and seen[4][1] == 1


def test_attention_gradient():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(7, quality.FEATURES)).astype(np.float64)
    first, y = np.array([0, 3, 4]), np.array([1.0, 0, 1])
    model = quality.AttentionMIL(hidden=4, gate=3)
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}

    def loss():
        s = model.forward(x, first)["score"]
        return -(y * np.log(s) + (1 - y) * np.log(1 - s)).mean()

    gradient = model.gradient(x, first, y, 0.0)
    for name, value in model.p.items():
        at = tuple(0 for _ in value.shape)
        before, value[at] = value[at], value[at] + 1e-6
        high = loss()
        value[at] = before - 1e-6
        low = loss()
        value[at] = before
        assert gradient[name][at] == pytest.approx((high - low) / 2e-6, abs=1e-6)


def brute_cost(codes):
    """The least cost over all sequences of choices, by trying each."""
    best = {0: 0}
    for c in codes:
        after = {}
        for p, cost in best.items():
            for role in range(3):
                label = 0 if role == c else chat.UNKNOWN if c == 3 else chat.RELABEL
                ways = [label + chat.MERGE] if p == 1 + role else []
                for n in range(4):
                    for path in itertools.product(range(3), repeat=n):
                        at, legal = p, True
                        for r in (*path, role):
                            legal &= r in chat._NEXT[at]
                            at = 1 + r
                        if legal:
                            ways.append(label + chat.INSERT * n)
                for w in ways:
                    after[1 + role] = min(after.get(1 + role, 1 << 30), cost + w)
        best = after
    return min(v + chat.CLOSING[s][0] for s, v in best.items())


ROLE = (*chat.ROLES, "tool")


def test_repair(spark, monkeypatch):
    monkeypatch.setattr(chat, "BLOCK_BITS", 2)
    rng = random.Random(3)
    talks = {i: [rng.randrange(4) for _ in range(rng.randrange(1, 9))] for i in range(24)}
    talks[99] = [rng.randrange(4) for _ in range(60)]  # over many blocks
    rows = [(i, t, ROLE[c] if c < 3 or t % 2 else None, f"text {i}.{t}", "x") for i, codes in talks.items() for t, c in enumerate(codes)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, action string")
    got = chat.repaired(df).orderBy("conv_id", "turn").collect()
    assert len(got) == len(rows)
    text = {}
    cost = {i: 0 for i in talks}
    for r in got:
        cost[r["conv_id"]] += r["cost"]
        text[r["conv_id"]] = text.get(r["conv_id"], "") + r["piece"]
        if r["last"]:
            cost[r["conv_id"]] += chat.CLOSING[1 + chat.ROLES.index(r["new_role"])][0]
    for i, codes in talks.items():
        assert cost[i] == brute_cost(codes), codes
        roles = re.findall(r"<\|im_start\|>(\w+)\n", text[i])
        legal = roles[1:] if roles[0] == "system" else roles
        assert legal == ["user", "assistant"] * (len(legal) // 2) and legal
        assert text[i].count("<|im_end|>") == len(roles) and text[i].endswith("<|im_end|>\n")
        assert [int(x) for x in re.findall(rf"text {i}\.(\d+)", text[i])] == list(range(len(codes)))
    whole = {r["conv_id"]: r["rendered"] for r in chat.rendered(df).collect()}
    assert whole == text


def test_chat_edges(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert chat.repaired(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, 0, "user", None), (1, 1, "assistant", ""), (None, 0, "user", "a"), (None, None, None, "b"), (2, 0, "user", "q"), (2, 0, "user", "q")]
    got = chat.repaired(spark.createDataFrame(rows, schema)).collect()
    assert len(got) == 6
    assert sorted(r["action"] for r in got if r["conv_id"] == 2) == ["keep", "merge"]
    assert [r["new_role"] for r in got if r["text"] == "b"] == ["assistant"]
