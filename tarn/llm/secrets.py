"""Secret scan: candidate strings judged by a random forest.

Candidates are runs of at least LEAST key characters with a digit or of mixed case, found on the
byte arrays of whole batches, and values of at least SHORT characters that are quoted or assigned
after a naming word. A forest trained from labelled findings removes the false ones by length,
character transitions, dictionary coverage, path marks and neighbouring words.
"""

from __future__ import annotations

import base64
import functools
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarn.llm.common import bounded_batches, byte_view, pieces, with_columns

LEAST = 16
#: Least length of a value after a naming word.
SHORT = 6
CHUNK_BYTES = 1 << 20
#: Text around a candidate that its features see, in bytes.
CONTEXT = 48

_KEY = np.zeros(256, bool)
_KEY[[ord(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_+/=.-"]] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[0x30:0x3A] = True
_UPPER = np.zeros(256, bool)
_UPPER[0x41:0x5B] = True
_LOWER = np.zeros(256, bool)
_LOWER[0x61:0x7B] = True
#: On lower-cased bytes: a naming word, the rest of its name, and a quoted or assigned value.
_NAMED = re.compile(
    rb"(?:token|key|secret|passw|pwd|api|auth|bearer|credential|private|access)[\w-]{0,24}[\"'`]?\s{0,4}"
    rb"(?:(?::=|=>|[:=])\s{0,4})?(?:(?<=[\s:=>])[\"'`]([^\s\"'`]{%d,})|(?<=[:=>\s])(?<!\w\s)([^\s\"'`,;&(){}\[\]<>=:]{%d,}))" % (SHORT, SHORT)
    + rb"|bearer\s{1,4}([^\s\"'`,;]{%d,})" % SHORT
)

#: Words that name a secret, and words that say that a string isn't one.
NAMING = frozenset("token key secret password passwd pwd apikey api auth bearer credential private access".split())
DENYING = frozenset("example sample test dummy placeholder your xxx fake commit sha checksum hash md5 uuid id digest".split())
#: Words that the labelled findings are made of.
PLAIN = (
    "account archive backup basket branch bridge button canvas carrier chapter client column corner counter default delivery desktop "
    "disabled document enabled engine export figure folder garden general handler harbor header history image index invoice journal "
    "kernel layout library license machine manager market master message missing module network number object office package parser "
    "partner picture planet profile project query random record region release report request response result schema script search "
    "section server service session setting signal source storage stream string student summary switch system table target template "
    "thread ticket update upload vendor version viewer window worker"
).split()
#: A public tokenizer's merges with their ranks; its words of four letters or more are the dictionary.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


@functools.lru_cache(4)
def dictionary(path: str = VOCABULARY) -> frozenset[str]:
    """Lower-cased words that the vocabulary holds whole, with the blank before them."""
    with open(path, "rb") as lines:
        entries = (base64.b64decode(line.split()[0]) for line in lines if line.strip())
        return frozenset(w[1:].decode().lower() for w in entries if w[:1] == b" " and len(w) > 4 and w[1:].isalpha())


FEATURES = (
    "length", "upper", "lower", "digit", "other", "changes", "entropy", "pair_entropy", "longest_run",
    "dictionary", "path", "named", "denied", "quoted", "assigned", "dashes",
)


def features(token: str, before: str, after: str, words: frozenset[str]) -> list[float]:
    n = len(token)
    kinds = ["U" if c.isupper() else "l" if c.islower() else "9" if c.isdigit() else "." for c in token]
    changes = sum(a != b for a, b in zip(kinds, kinds[1:])) / max(n - 1, 1)
    counts = {c: token.count(c) for c in set(token)}
    entropy = -sum(v / n * math.log2(v / n) for v in counts.values())
    steps: dict = {}
    for a, b in zip(token, token[1:]):
        steps[ord(b) - ord(a)] = steps.get(ord(b) - ord(a), 0) + 1
    moves = -sum(v / (n - 1) * math.log2(v / (n - 1)) for v in steps.values()) if n > 1 else 0.0
    run = max(len(m[0]) for m in re.finditer(r"(.)\1*", token))
    letters = re.findall(r"[A-Za-z][a-z]+|[A-Z]+", token)
    known = sum(len(w) for w in letters if w.lower() in words)
    near = [w.lower() for w in re.findall(r"[A-Za-z]+", before)][-3:]
    tail = before.rstrip()
    return [
        float(n),
        kinds.count("U") / n,
        kinds.count("l") / n,
        kinds.count("9") / n,
        kinds.count(".") / n,
        changes,
        entropy,
        moves,
        run / n,
        known / n,
        float(token.count("/") + ("://" in before[-12:]) * 2 + bool(re.search(r"\.[a-z]{2,4}$", token))),
        float(any(w in NAMING for w in near)),
        float(any(w in DENYING for w in near)),
        float(before[-1:] in "\"'`" and before != ""),
        float(tail[-1:] in "=:" or tail[:-1].rstrip()[-1:] in "=:"),
        token.count("-") / n,
    ]


class Forest:
    """Gini trees on bootstrap samples with random feature subsets; deterministic by seed."""

    def __init__(self, trees: int = 40, depth: int = 7, leaf: int = 2, seed: int = 3):
        self.trees, self.depth, self.leaf, self.seed = trees, depth, leaf, seed
        self.nodes: list[list[tuple]] = []

    def fit(self, x: np.ndarray, y: np.ndarray) -> Forest:
        rng = np.random.default_rng(self.seed)
        for _ in range(self.trees):
            at = rng.integers(0, len(x), len(x))
            nodes: list[tuple] = []
            self._grow(x[at], y[at], 0, nodes, rng)
            self.nodes.append(nodes)
        return self

    def _grow(self, x, y, depth, nodes, rng) -> int:
        me = len(nodes)
        nodes.append((-1, 0.0, 0, 0, float(y.mean())))
        if depth == self.depth or len(y) < 2 * self.leaf or y.min() == y.max():
            return me
        best = (math.inf, -1, 0.0)
        for f in rng.choice(x.shape[1], max(1, math.isqrt(x.shape[1])), replace=False):
            order = np.argsort(x[:, f], kind="stable")
            v, c = x[order, f], np.cumsum(y[order])
            n = np.arange(1, len(y))
            left, right = c[:-1] / n, (c[-1] - c[:-1]) / (len(y) - n)
            cost = n * left * (1 - left) + (len(y) - n) * right * (1 - right)
            cost[(v[1:] == v[:-1]) | (n < self.leaf) | (len(y) - n < self.leaf)] = math.inf
            k = int(np.argmin(cost))
            if cost[k] < best[0]:
                best = (cost[k], int(f), (v[k] + v[k + 1]) / 2)
        if best[1] < 0:
            return me
        side = x[:, best[1]] <= best[2]
        left = self._grow(x[side], y[side], depth + 1, nodes, rng)
        right = self._grow(x[~side], y[~side], depth + 1, nodes, rng)
        nodes[me] = (best[1], best[2], left, right, nodes[me][4])
        return me

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for nodes in self.nodes:
            f, cut, left, right, value = (np.array(c) for c in zip(*nodes))
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                inner = f[at] >= 0
                go = x[np.arange(len(x)), np.maximum(f[at], 0)] <= cut[at]
                at = np.where(inner, np.where(go, left[at], right[at]), at)
            total += value[at]
        return total / max(len(self.nodes), 1)


def findings(n: int = 240, seed: int = 11) -> list[tuple[str, str, str, int]]:
    """The labelled findings (before, token, after, label), drawn from the kinds a review meets.

    Secrets: random hex, base64 and prefixed keys, mostly where a name assigns them, short
    passwords and letter-only tokens. False ones: ids in paths, versions, checksums named as
    such, counters, placeholders, file names, plain words after a name, identifiers, references.
    """
    rng = np.random.default_rng(seed)
    hexa, base, digits = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "0123456789"

    def draw(alphabet: str, k: int) -> str:
        return "".join(alphabet[i] for i in rng.integers(0, len(alphabet), k))

    def pick(*of):
        return of[int(rng.integers(0, len(of)))]

    out = []
    for i in range(n):
        length = int(pick(20, 24, 32, 40, 40, 48, 64))
        if i % 2 == 0:
            token = pick(
                draw(hexa, length), draw(hexa, 40).upper(), draw(base, length), "ghp_" + draw(base, 36),
                "AKIA" + draw(base[:26] + digits, 16), "sk-" + draw(base, 40), draw(base, length) + "==",
            )
            before = pick('auth_token = "', 'CLIENT_TOKEN="', "api_key: ", 'password = "', "secret='", "Bearer ", "access key ", 'export KEY="', 'token: "', "token='")
            out.append((pick("", "please note ", "and then\n", "config of the build: ") + before, token, '"', 1))
        else:
            words = PLAIN
            token, before = pick(
                (draw(digits, int(pick(16, 18, 20))), pick("order ", "number ", "and the ", "en ")),
                (f"{pick(*words)}-{pick(*words)}-{draw(digits, 4)}.{pick('html', 'json', 'png')}", "see "),
                (f"/{pick(*words)}/{pick(*words)}/{draw(hexa, 8)}/{pick(*words)}.png", "https://www.example.com"),
                (draw(hexa, 40), pick("commit ", "checksum ", "sha ", "digest: ")),
                (pick("x", "0", "a") * length + "1", pick('my_token = "', "key: ")),
                ("1234567890abcdef" * 2, pick('a_token = "', "example key: ")),
                ("your_" + pick("token", "key") + "_here_12345", 'app_token = "'),
                (f"{draw(hexa, 8)}-{draw(hexa, 4)}-{draw(hexa, 4)}-{draw(hexa, 4)}-{draw(hexa, 12)}", pick("uuid ", "id ", "id: ")),
                (f"{pick(*words)}_{pick(*words)}_{pick(*words)}_v{draw(digits, 2)}", "the "),
                (f"2023-{draw(digits, 2)}-{draw(digits, 2)}T10-{draw(digits, 2)}-00.000Z", "at "),
            )
            out.append((pick("", "please note ", "and then\n", "config of the build: ") + before, token, " ", 0))
    letters, low = base[:52], base[26:52]
    words = PLAIN

    def ordinary() -> str:
        return "".join(pick("ba", "con", "ter", "mi", "sol", "re", "pan", "ti", "der", "lo") for _ in range(int(pick(3, 4, 6))))

    for i in range(n // 2):
        name = pick('password = "', 'pwd="', "password: ", "pwd=", "PASSWORD=", "secret='", 'api_key = "', 'PASSWORD="', 'auth token: "')
        if i % 2 == 0:
            before, token = pick(
                (name, draw(low, int(pick(5, 6, 7))) + draw(digits, int(pick(1, 2, 4))) + pick("", "-prod", "_dev", "!")),
                (name, ordinary() + draw(digits, int(pick(1, 2, 4))) + pick("", "-prod", "!", "#x")),
                (name, pick(*words) + draw(digits, int(pick(1, 2, 4))) + pick("", "-" + pick(*words)[:4], "_x", "!")),
                (name, draw(base, int(pick(8, 10, 12, 14)))),
                (name, draw(low, int(pick(10, 14, 20)))),
                (name, draw(letters, int(pick(10, 16, 24, 40)))),
                (pick("", "the ", "Bearer ") + pick('user_token = "', ""), draw(letters, int(pick(20, 24, 32, 40)))),
                (name, pick("P@", "x!", "#") + draw(base, int(pick(6, 8, 10))) + pick("!", "$", "")),
            )
            out.append((pick("", "please note ", "and then\n", "config of the build: ") + before, token, pick('"', "'", "\n"), 1))
        else:
            one, two, three = pick(*words), pick(*words), pick(*words)
            before, token = pick(
                (name, pick(*words) + pick(*words)),
                (pick("password: ", "key: ", "access: ", "token: ", "The key: "), pick(*words, ordinary(), ordinary())),
                (name, pick("${", "{{", "<", "%(") + one + "_" + two + pick("}", "}}", ">", ")s")),
                (name, f"{pick('process.env', 'os.environ', 'self', 'request', 'config')}.{one}"),
                (name, pick("x", "*", ".", "-", "a", "0") * int(pick(6, 8, 12))),
                (name, "your" + pick("-", "_", "") + pick("password", "token", "secret") + pick("", "-here")),
                (pick("the ", "call ", "see ", ""), one + two.title() + three.title() + pick("", "Manager", "Service", "Source")),
                (pick("the ", "import ", "see "), f"org.{one}.{two}.{three.title()}{one.title()}"),
                (pick("the ", "in ", "of "), ordinary().title() + ordinary() + pick("", "-" + ordinary().title())),
                (pick("see ", "https://"), f"{one.title()}/{two.title()}-{three}.{pick('html', 'md', 'png')}"),
            )
            out.append((pick("", "please note ", "and then\n", "config of the build: ") + before, token, pick(" ", ".", '"'), 0))
    return out


def train(rows: list[tuple[str, str, str, int]] | None = None, words: frozenset[str] | None = None) -> Forest:
    rows, words = rows or findings(), words or dictionary()
    x = np.array([features(token, before, after, words) for before, token, after, _ in rows])
    return Forest().fit(x, np.array([r[3] for r in rows], float))


def candidates(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, byte start and byte end of the candidates, by start.

    They are maximal runs of key characters with a digit, or of mixed case, and the named values
    that don't overlap one.
    """
    n = len(data)
    if n == 0:
        return (np.empty(0, np.int64),) * 3
    inside = _KEY[data]
    left = np.concatenate(([False], inside[:-1]))
    right = np.concatenate((inside[1:], [False]))
    left[offsets[:-1][offsets[:-1] < n]] = False
    right[offsets[1:][offsets[1:] > 0] - 1] = False
    starts, ends = np.flatnonzero(inside & ~left), np.flatnonzero(inside & ~right) + 1
    long_ = ends - starts >= LEAST
    starts, ends = starts[long_], ends[long_]

    def has(kind: np.ndarray) -> np.ndarray:
        sums = np.concatenate(([0], np.cumsum(kind[data])))
        return sums[ends] > sums[starts]

    some = has(_DIGIT) | (has(_UPPER) & has(_LOWER))
    starts, ends = starts[some], ends[some]
    first, last = named(data, offsets)
    # A run that ends after the value's start, and starts before its end.
    apart = np.searchsorted(ends, first, side="right") == np.searchsorted(starts, last, side="left")
    starts, ends = np.concatenate((starts, first[apart])), np.concatenate((ends, last[apart]))
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], ends[order]
    return np.searchsorted(offsets, starts, side="right") - 1, starts, ends


def named(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte start and end of the values after naming words; none goes over rows."""
    raw = data.tobytes().lower()
    spans = []
    for low, high in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        for m in _NAMED.finditer(raw, low, high):
            start, end = m.span(m.lastindex)
            if m.lastindex > 1:  # unquoted: without the sentence's punctuation
                end = start + len(raw[start:end].rstrip(b".,:!?)"))
            if end - start >= SHORT:
                spans.append((start, end))
    found = np.array(spans, np.int64).reshape(-1, 2)
    return found[:, 0], found[:, 1]


def secrets(
    docs: DataFrame, text: str = "text", forest: Forest | None = None, threshold: float = 0.5, vocabulary: str = VOCABULARY
) -> DataFrame:
    """``docs`` with n_candidates, n_secrets and secret_spans added.

    Spans are start:end:score in code points, end exclusive, comma-joined by start. A key
    character's trailing '=', '.' and '-' belong to its run. Null and empty texts have none;
    repeated rows are judged one by one. Added columns replace input columns of the same names.
    ``vocabulary`` is the driver's file of words; what they are goes to the tasks.
    """
    docs = bounded_batches(docs.drop("n_candidates", "n_secrets", "secret_spans"))
    known = dictionary(vocabulary)
    model = docs.sparkSession.sparkContext.broadcast((forest or train(words=known), known))
    schema = T.StructType(
        docs.schema.fields
        + [
            T.StructField("n_candidates", T.LongType()),
            T.StructField("n_secrets", T.LongType()),
            T.StructField("secret_spans", T.StringType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees, known = model.value
        for piece in pieces(batches, text, CHUNK_BYTES):
            data, offsets = byte_view(piece.column(text))
            row, starts, ends = candidates(data, offsets)
            rows = piece.num_rows
            kept: list[list[str]] = [[] for _ in range(rows)]
            n_secrets = np.zeros(rows, np.int64)
            if len(row):
                raw = []
                for r, s, e in zip(row, starts, ends):
                    before = data[max(offsets[r], s - CONTEXT) : s].tobytes().decode("utf-8", "ignore")
                    after = data[e : min(offsets[r + 1], e + CONTEXT)].tobytes().decode("utf-8", "ignore")
                    raw.append(features(data[s:e].tobytes().decode(), before, after, known))
                score = trees.score(np.array(raw))
                # Code points before a byte: bytes that don't continue a character.
                head = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
                for r, s, e, p in zip(row, starts, ends, score):
                    if p >= threshold:
                        at = head[s] - head[offsets[r]]
                        kept[r].append(f"{at}:{head[e] - head[offsets[r]]}:{p:.3f}")
                        n_secrets[r] += 1
            extra = {
                "n_candidates": pa.array(np.bincount(row, minlength=rows), pa.int64()),
                "n_secrets": pa.array(n_secrets, pa.int64()),
                "secret_spans": pa.array([",".join(k) for k in kept], pa.string()),
            }
            fields = [piece.schema.field(i) for i in range(piece.num_columns)]
            fields += [pa.field(k, v.type) for k, v in extra.items()]
            yield with_columns(pa.schema(fields), piece, extra)

    return docs.mapInArrow(run, schema)


def secrets_query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return secrets(docs).select("doc_id", "n_candidates", "n_secrets", F.col("secret_spans").alias("spans"))
