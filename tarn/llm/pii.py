"""Personal data: fixed patterns plus a linear-chain conditional random field.

The patterns give the base spans. The field adds spans that they miss (a phone number without
its plus sign, say): tokens of word shapes, trained on a small labelled table, decoded by
Viterbi over padded numpy batches. Tokens with neither a digit nor an at sign can only be
outside, so the chain falls apart there and only runs of other tokens are decoded: the best
labelling is that of the whole text.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarn.llm.common import bounded_batches, pieces, with_columns

KINDS = ("email", "ip", "card", "phone")
CHUNK_BYTES = 1 << 20

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A match starts where a run of digits starts or not at all, so inner digits are skipped.
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_MARK = re.compile(r"[0-9@]")
_SPACE = re.compile(r"\s")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        if k % 2:
            n = n * 2 - 9 if n > 4 else n * 2
        total += n
    return total % 10 == 0


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and part <= "255"


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, sorted; leftmost matches that fail are dropped."""
    found = []
    end = at = 0
    while (at := text.find("@", at)) >= 0:
        # The leftmost start before this sign is that of its run of local characters.
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            found.append((start, 0, m.end()))
            end = m.end()
            at = end
        else:
            at += 1
    for m in _IP.finditer(text):
        if all(map(_small, m[0].split("."))):
            found.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            found.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_digits(m[0])) <= 15:
                found.append((m.start(), 3, m.end()))
    return sorted(found)


#: Contexts and values of the labelled table. Values are from ranges that are reserved for fiction,
#: documentation and tests, so none belongs to anyone or to a corpus; # is a random digit.
CONTEXTS = {
    "phone": (
        "call {} before six", "my mobile is {} , bye", "phone: {}", "the clinic answers at {} daily", "ring {} for a table",
        "text {} and ask", "tel. {} (office)", "reception, {} , second floor", "fax number {} please", "you reach us on {} today",
    ),
    "email": ("mail {} about it", "write to {} soon", "copy {} on this", "contact: {}", "from {} last week", "ask {} first"),
    "ip": ("ping {} first", "host {} went down", "server {} answers", "blocked {} again", "traffic from {} rose", "bind to {} only"),
    "card": ("paid with {} again", "card {} expires", "charge {} today", "my card number is {} thanks", "refund to {} please"),
    "": (
        "see {} for more", "number {} on the list", "it says {} there", "page {} of it", "around {} of them", "the code {} failed",
        "in {} we moved", "order {} shipped", "version {} came out", "from {} to the end", "model {} sold", "figure {} shows",
    ),
}
VALUES = {
    "phone": (
        "(20#) 555-01##", "30#-555-01##", "40#.555.01##", "(50#) 555 01##", "020 7946 0###", "0117 496 0###", "01632 960###",
        "001-20#-555-01##", "+1 (70#) 555-01##", "+44 20 7946 0###", "555-01##", "1-80#-555-01##", "60# 555 01##",
    ),
    "email": ("ops@intranet", "maria.k@mailhost", "team_#@relay", "r.stone@example.org", "dev+#@example.net", "h-#@backup", "info@desk#"),
    "ip": ("192.0.2.#", "198.51.100.##", "203.0.113.1##", "192.0.2.2##:8080"),
    "card": (
        "4242 4242 4242 4242", "5555-5555-5555-4444", "3782 822463 10005", "6011111111111117", "4000.0566.5566.5556", "3056 9300 0902 0004",
        "4242/4242/4242/4242", "5105 1051 0510 5100",
    ),
    "": (
        "20##-0#-1#", "1#:3#", "1#:3#:4#", "3.#.1#", "2.#.#.#.#", "1##0-1##5", "978-0-3#-4#8410-#", "1,2##.##", "3.# million", "12# 34# 56#",
        "#-#", "2#/0#/20##", "A##-2##", "#th", "0x3f#a", "c0ffee##beef##", "70###", "#### #### ####", "4242 4242 4242 4241", "1234#678901234#6",
        "300.4#.1.1", "@someone##", "5 @ 2", "(#) of (##)", "1##0x7##", "#.##%", "1914-191#", "v#.##.#-rc#", "7f3a##e9-1b#c-4d5e-8f6a-0b1c2d3e4f5a", "98####0###",
        "99##-####-##", "e3b0#442##fc1c149#fb92#27ae41e4649b#34ca49", "0#4d1##a77e0d4b#c5f6a8e2#3e1d2#7f09c8d#", "### - ###", "#,###,###", "part 2##-5##", "19##-20## and 20##",
        "apple# stone## river#", "lamp## desk# cup## pen# ink##", "a# b# c# d# e# f# g#", "row## col# row# col## row## col#", "unit# x## unit#",
        "green#, table##, water# paper##, lamp#", "## # ### ## # ####", "k#=v## k##=v# k#=v#",
    ),
}


def labelled_table(n: int = 420, seed: int = 17) -> list[str]:
    """The labelled lines, spans written as <kind|text>: every value in turn, in a context drawn for it."""
    rng = np.random.default_rng(seed)

    def filled(pattern: str) -> str:
        return "".join(str(rng.integers(0, 10)) if c == "#" else c for c in pattern)

    pairs = [(kind, value) for kind, values in VALUES.items() for value in values]
    out = []
    for i in range(n):
        kind, value = pairs[i % len(pairs)]
        context = CONTEXTS[kind][int(rng.integers(0, len(CONTEXTS[kind])))]
        marked = filled(value)
        out.append(context.format(f"<{kind}|{marked}>" if kind else marked))
    return out


STATES = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
N_STATES = len(STATES)
#: Hash space of the features; its weights are the whole model.
SPACE = 1 << 12


def _shape(token: str, squeeze: bool) -> str:
    out = []
    for c in token:
        s = "9" if "0" <= c <= "9" else "a" if c.islower() else "A" if c.isalpha() else c
        if not (squeeze and out and out[-1] == s):
            out.append(s)
        if len(out) >= 40:
            break
    return "".join(out)


def token_features(tokens: list[str], k: int, left: str, right: str) -> list[int]:
    """Hashed features of token k of a run; left and right are the words around the run."""

    def around(at: int) -> str:
        if at < 0:
            return "w:" + left.lower()[:12]
        if at >= len(tokens):
            return "w:" + right.lower()[:12]
        return "s:" + _shape(_core(tokens[at])[0], False)

    core, _, _ = _core(tokens[k])
    digits = _digits(core)
    parts = core.split(".")
    names = [
        "bias",
        "full:" + _shape(core, False),
        "short:" + _shape(core, True),
        f"n:{min(len(digits), 20)}",
        "prev:" + around(k - 1),
        "next:" + around(k + 1),
        "pair:" + _shape(core, False) + "|" + around(k - 1),
        f"at:{'@' in core[1:-1]}",
        f"hex:{bool(re.search('[a-zA-Z]', core)) and '@' not in core}",
    ]
    if 13 <= len(digits) <= 19:
        names.append(f"luhn:{luhn(digits) and len(set(digits)) > 1}")
    if len(parts) == 4 and all(p.isdigit() and p.isascii() for p in parts):
        names.append(f"ip:{all(map(_small, parts))}")
    return [zlib.crc32(n.encode()) % SPACE for n in names]


_EDGE = "\"'`,;:!?.*%&$#<>[]{}|=-"


def _core(token: str) -> tuple[str, int, int]:
    """The token without outer punctuation, and where it starts and ends in it."""
    end = len(token.rstrip(_EDGE))
    start = end - len(token[:end].lstrip(_EDGE))
    core = token[start:end]
    if core.endswith(")") and "(" not in core:
        end, core = end - 1, core[:-1]
    if core.startswith("(") and ")" not in core:
        start, core = start + 1, core[1:]
    return core, start, end


def runs(text: str) -> list[tuple[list[tuple[int, int]], str, str]]:
    """Maximal runs of tokens with a digit or at sign: token places, the word before and after."""
    out: list[list[tuple[int, int]]] = []
    at = 0
    while m := _MARK.search(text, at):
        start = m.start()
        floor = at
        while start > floor and not text[start - 1].isspace():
            start -= 1
        space = _SPACE.search(text, m.end())
        end = space.start() if space else len(text)
        if out and not text[out[-1][-1][1] : start].strip():
            out[-1].append((start, end))
        else:
            out.append([(start, end)])
        at = end
    found = []
    for run in out:
        before = text[max(0, run[0][0] - 40) : run[0][0]].split()
        after = text[run[-1][1] : run[-1][1] + 40].split()
        found.append((run, before[-1] if before else "", after[0] if after else ""))
    return found


def unmarked(line: str) -> tuple[str, list[tuple[int, int, int]]]:
    """The text of a labelled line and its spans (start, end, kind)."""
    text, spans = "", []
    for piece in re.split(r"(<\w+\|[^>]*>)", line):
        if m := re.fullmatch(r"<(\w+)\|([^>]*)>", piece):
            spans.append((len(text), len(text) + len(m[2]), KINDS.index(m[1])))
            piece = m[2]
        text += piece
    return text, spans


def labelled(lines: list[str]) -> list[tuple[list[str], list[int], str, str]]:
    """Training runs (tokens, states, word before, word after) of the marked lines."""
    out = []
    for line in lines:
        text, spans = unmarked(line)
        for run, left, right in runs(text):
            states = []
            for a, b in run:
                kind = next(((s, k) for s, e, k in spans if a < e and s < b), None)
                states.append(0 if kind is None else 1 + 2 * kind[1] + (a > kind[0]))
            out.append(([text[a:b] for a, b in run], states, left, right))
    return out


def _allowed() -> np.ndarray:
    """0 for legal transitions, -1e9 for an inside state that doesn't continue its kind."""
    out = np.zeros((N_STATES + 1, N_STATES), np.float64)  # last row: the start
    for b in range(2, N_STATES, 2):
        for a in range(N_STATES + 1):
            if a not in (b - 1, b):
                out[a, b] = -1e9
    return out


class ChainField:
    """A linear-chain conditional random field fitted by gradient ascent on its log-likelihood."""

    def __init__(self) -> None:
        self.emit = np.zeros((SPACE, N_STATES))
        self.move = np.zeros((N_STATES + 1, N_STATES))
        self.rule = _allowed()

    def potentials(self, features: list[list[int]]) -> np.ndarray:
        return np.stack([self.emit[f].sum(axis=0) for f in features])

    def fit(self, data: list, steps: int = 120, rate: float = 0.5, decay: float = 1e-3) -> ChainField:
        """All runs at once, padded to the longest; forward and backward sums go token by token over the batch."""
        data = [row for row in data if row[0]]
        n, wide = len(data), max(len(t) for t, _, _, _ in data)
        encoded = [[token_features(t, k, l, r) for k in range(len(t))] for t, _, l, r in data]
        deep = max(len(f) for features in encoded for f in features)
        ids = np.full((n, wide, deep), SPACE)  # an extra row of zeros
        states = np.zeros((n, wide), np.int64)
        here = np.zeros((n, wide), bool)
        for i, (features, (_, own, _, _)) in enumerate(zip(encoded, data)):
            here[i, : len(own)] = True
            states[i, : len(own)] = own
            for k, f in enumerate(features):
                ids[i, k, : len(f)] = f
        truth = np.eye(N_STATES)[states] * here[:, :, None]
        last = here.sum(axis=1) - 1
        row = np.arange(n)
        g_emit, g_move = np.zeros_like(self.emit), np.zeros_like(self.move)
        for _ in range(steps):
            u = np.append(self.emit, np.zeros((1, N_STATES)), axis=0)[ids].sum(axis=2)
            move = self.move + self.rule
            alpha, beta = np.zeros((n, wide, N_STATES)), np.zeros((n, wide, N_STATES))
            alpha[:, 0] = u[:, 0] + move[-1]
            for k in range(1, wide):
                alpha[:, k] = u[:, k] + _logsum(alpha[:, k - 1, :, None] + move[:-1], 1)
            for k in range(wide - 2, -1, -1):
                after = _logsum(move[:-1] + (u[:, k + 1] + beta[:, k + 1])[:, None, :], 2)
                beta[:, k] = np.where(here[:, k + 1, None], after, 0)
            z = _logsum(alpha[row, last], 1)
            change = truth - np.exp(np.minimum(alpha + beta - z[:, None, None], 0)) * here[:, :, None]
            d_emit, d_move = -decay * self.emit, -decay * self.move
            flat = ids[here].ravel()
            for s in range(N_STATES):
                weights = np.repeat(change[here][:, s], deep)
                d_emit[:, s] += np.bincount(flat, weights, minlength=SPACE + 1)[:SPACE]
            d_move[-1] += change[:, 0].sum(axis=0)
            for k in range(1, wide):
                some = here[:, k]
                both = alpha[some, k - 1, :, None] + move[:-1] + (u[some, k] + beta[some, k])[:, None, :] - z[some, None, None]
                d_move[:-1] -= np.exp(both).sum(axis=0)
                np.add.at(d_move, (states[some, k - 1], states[some, k]), 1)
            g_emit += d_emit**2
            g_move += d_move**2
            self.emit += rate * d_emit / (np.sqrt(g_emit) + 1e-6)
            self.move += rate * d_move / (np.sqrt(g_move) + 1e-6)
        return self

    def viterbi(self, batch: list[list[list[int]]]) -> list[np.ndarray]:
        """The best states of many runs at once: runs are sorted by length and advance together."""
        if not batch:
            return []
        sizes = np.array([len(x) for x in batch])
        order = np.argsort(-sizes, kind="stable")
        sizes = sizes[order]
        starts = np.cumsum(sizes) - sizes
        u = np.concatenate([self.potentials(batch[i]) for i in order])
        move = self.move + self.rule
        score = u[starts] + move[-1]
        back = np.zeros((len(u), N_STATES), np.int8)
        for k in range(1, int(sizes[0])):
            live = int(np.searchsorted(-sizes, -k, side="left"))
            step = score[:live, :, None] + move[None, :-1]
            back[starts[:live] + k] = step.argmax(axis=1)
            score[:live] = step.max(axis=1) + u[starts[:live] + k]
        out: list = [None] * len(batch)
        for row, i in enumerate(order):
            states = np.zeros(sizes[row], np.int64)
            states[-1] = score[row].argmax()
            for k in range(sizes[row] - 1, 0, -1):
                states[k - 1] = back[starts[row] + k, states[k]]
            out[i] = states
        return out


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    most = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - most).sum(axis=axis)) + most.squeeze(axis)


_PLAIN_NUMBER = re.compile(r"[0-9 ()+./\s-]+")


def holds(kind: int, text: str) -> bool:
    """Whether a text can be one value of its kind, as to its characters and number of digits.

    An email is one token with an at sign inside, an address four small numbers (and a port), a card
    13 to 19 digits, a phone 7 to 15; cards and phones have no letters.
    """
    if kind == 0:
        return "@" in text[1:-1] and not _SPACE.search(text)
    if kind == 1:
        parts = text.partition(":")[0].split(".")
        return len(parts) == 4 and all(p.isdigit() and p.isascii() and _small(p) for p in parts)
    least, most = (13, 19) if kind == 2 else (7, 15)
    return least <= len(_digits(text)) <= most and _PLAIN_NUMBER.fullmatch(text) is not None


def _values(text: str, kind: int, tokens: list[tuple[int, int]]) -> Iterator[tuple[int, int, int]]:
    """The values in a run of tokens that the field labels as one: the whole, or else complete ones from the left.

    A card of right check digit goes before a longer run of digits.
    """

    def trimmed(i: int, j: int) -> tuple[int, int]:
        a, b = tokens[i][0], tokens[j][1]
        a += _core(text[a : tokens[i][1]])[1] if text[a] != "+" else 0
        return a, tokens[j][0] + _core(text[tokens[j][0] : b])[2]

    i = 0
    while i < len(tokens):
        # No value has more tokens than digits.
        spans = [(j, *trimmed(i, j)) for j in range(i, min(len(tokens), i + 19))]
        fits = [(j, a, b) for j, a, b in spans if a < b and holds(kind, text[a:b])]
        checked = [x for x in fits if kind == 2 and luhn(_digits(text[x[1] : x[2]]))]
        if not fits:
            i += 1
            continue
        j, a, b = (checked or fits)[-1]
        yield a, kind, b
        i = j + 1


def field_spans(texts: list[str], base: list[list[tuple]], field: ChainField) -> list[list[tuple[int, int, int]]]:
    """Spans of the field that touch no base span and can hold a value of their kind."""
    places, encoded = [], []
    for i, text in enumerate(texts):
        if text and _MARK.search(text):
            for run, left, right in runs(text):
                tokens = [text[a:b] for a, b in run]
                encoded.append([token_features(tokens, k, left, right) for k in range(len(tokens))])
                places.append((i, run))
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for (i, run), states in zip(places, field.viterbi(encoded)):
        k = 0
        while k < len(run):
            if states[k] == 0:
                k += 1
                continue
            end = k + 1
            while end < len(run) and states[end] == states[k] + (states[k] % 2) and states[end] % 2 == 0:
                end += 1
            for a, kind, b in _values(texts[i], (int(states[k]) - 1) // 2, run[k:end]):
                if not any(s < b and a < e for s, _, e in base[i]):
                    out[i].append((a, kind, b))
            k = end
    return out


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def train(lines: list[str] | None = None) -> ChainField:
    return ChainField().fit(labelled(lines or labelled_table()))


def held_out_report(every: int = 5) -> dict[str, tuple[float, float, int]]:
    """Precision, recall and spans by kind, of patterns and field together, on each ``every``-th labelled line."""
    lines = labelled_table()
    field = train([x for i, x in enumerate(lines) if i % every])
    asked = [unmarked(x) for x in lines[::every]]
    texts = [t for t, _ in asked]
    base = [base_spans(t) for t in texts]
    more = field_spans(texts, base, field)
    out = {}
    for k, kind in enumerate(KINDS):
        want = {(i, a, b) for i, (_, spans) in enumerate(asked) for a, b, x in spans if x == k}
        got = {(i, a, b) for i in range(len(texts)) for a, x, b in base[i] + more[i] if x == k}
        both = len(want & got)
        out[kind] = (both / max(1, len(got)), both / max(1, len(want)), len(want))
    return out


def personal_data(docs: DataFrame, text: str = "text", field: ChainField | None = None) -> DataFrame:
    """``docs`` with n_email, n_ip, n_card, n_phone, n_field, base_spans and spans added.

    Counts by kind and base_spans are those of the fixed patterns; spans has also the n_field
    spans that the field adds. Spans are kind:start:end in code points, end exclusive, by start and then kind. Null
    and empty texts have none. Repeated rows are judged one by one. Added columns replace
    input columns of the same names.
    """
    spark = docs.sparkSession
    names = [f"n_{k}" for k in KINDS] + ["n_field", "base_spans", "spans"]
    docs = bounded_batches(docs.drop(*names))
    model = spark.sparkContext.broadcast(field or train())
    added = [T.StructField(f"n_{k}", T.LongType()) for k in (*KINDS, "field")]
    added += [T.StructField("base_spans", T.StringType()), T.StructField("spans", T.StringType())]
    schema = T.StructType(docs.schema.fields + added)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, text, CHUNK_BYTES):
            texts = [t or "" for t in piece.column(text).to_pylist()]
            base = [base_spans(t) if _MARK.search(t) else [] for t in texts]
            more = field_spans(texts, base, model.value)
            extra = {
                f"n_{kind}": pa.array([sum(s[1] == k for s in b) for b in base], pa.int64())
                for k, kind in enumerate(KINDS)
            }
            extra["n_field"] = pa.array(list(map(len, more)), pa.int64())
            extra["base_spans"] = pa.array([_joined(b) for b in base], pa.string())
            extra["spans"] = pa.array([_joined(b + m) for b, m in zip(base, more)], pa.string())
            fields = [piece.schema.field(i) for i in range(piece.num_columns)]
            fields += [pa.field(k, v.type) for k, v in extra.items()]
            yield with_columns(pa.schema(fields), piece, extra)

    return docs.mapInArrow(run, schema)


def digest(spans: str) -> str:
    return hashlib.sha256(spans.encode()).hexdigest()


def personal_data_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = personal_data(docs)
    return found.select(
        "doc_id", *[f"n_{k}" for k in KINDS], F.sha2("base_spans", 256).alias("base_sha256"), "spans", "n_field"
    )
