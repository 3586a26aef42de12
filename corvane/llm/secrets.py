"""Secret scans: pattern candidates, and a random forest that drops the false ones.

Candidates are long unbroken tokens, values assigned to a named setting, and passwords in addresses. The forest sees a
candidate's length, its character-class transitions and byte entropy, how much of it dictionary words cover, whether it
stands in a path or address, what kind of path its document has (column ``path`` if there is one, ``source`` otherwise),
and the words next to it. It is trained here, in numpy, from labelled findings: either a caller's, or the generated
ones of ``labelled_findings``, which hold real key shapes against digests, identifiers, paths, placeholders and prose.

An assigned value is a candidate of its own: the token ``name=VALUE`` around it is split, so that the name counts as
the words before the value. Training describes the spans that ``candidates`` gives, as a scan does.

Edge cases: a null or empty text has no findings; other overlapping candidates are merged into the longest one; repeated
rows are scanned one by one; a document without a path is judged by its text alone; other columns are ignored by the
scan; documents without findings have no row in ``scan`` and one row in ``scan_documents``; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from corvane.llm import common as C

TREES, DEPTH, LEAST_LEAF, SEED = 40, 10, 3, 11
#: Generated labelled findings; a fixed number whatever the corpus holds.
FINDINGS = 6_000
THRESHOLD = 0.5
CONTEXT = 48

# Forms that candidates take.
TOKEN = re.compile(r"[A-Za-z0-9+/_=\-.~]{16,}")
ASSIGNED = re.compile(r"""(?i)(?:pass(?:word|wd)?|pwd|secret|token|api[_-]?key|access[_-]?key|auth|credential)s?["']?\s{0,3}[:=]\s{0,3}["']?([^\s"'<>,;]{6,})""")
BLOCK = re.compile(r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----[A-Za-z0-9+/=\s]{16,}?-----END [A-Z ]{0,30}PRIVATE KEY-----")
ADDRESS = re.compile(r"://[^\s/:@\"'<>]{0,64}:([^\s/@\"'<>]{3,})@")
#: The head of an assignment inside an assigned value (``auth: token=VALUE``), and the name in front of a token's value.
NESTED = re.compile(r"(?i)[a-z_.\-]{0,32}?(?:pass(?:word|wd)?|pwd|secret|token|api[_-]?key|access[_-]?key|auth|credential)s?[:=](?=[^\s\"'<>,;]{6})")
NAMED = re.compile(r"([A-Za-z_][A-Za-z0-9_.\-]{0,63})=(?!=)")
PREFIX = re.compile(r"^(?:AKIA|ASIA|ghp_|gho_|github_pat_|glpat-|sk-|sk_live_|rk_live_|xox[abprs]-|AIza|eyJ|SG\.|npm_|pypi-|hf_)")
KEYWORDS = ("password", "passwd", "pwd", "secret", "token", "api_key", "apikey", "api-key", "access_key", "auth", "bearer", "credential", "private", "key")
BENIGN = ("sha", "md5", "commit", "checksum", "digest", "hash", "uuid", "revision", "version", "build", "etag", "integrity", "example", "placeholder", "sample", "id", "file", "path", "url", "http", "www", "see", "page", "base64", "image", "data", "font", "thumbprint", "fingerprint", "signature")
#: Parts of a path that tell settings from examples and generated files.
SETTINGS = ("env", "config", "conf", "secret", "credential", "settings", "deploy", "terraform", "docker", "vault")
SAMPLES = ("test", "example", "sample", "doc", "fixture", "mock", "lock", "min.js", "readme", "vendor")
PLACEHOLDER = ("example", "your", "changeme", "placeholder", "xxxx", "dummy", "sample", "redacted", "insert", "test", "todo", "1234567890", "abcdef")
#: A small dictionary by which coverage is measured; short stems, so that they match inside tokens.
STEMS = frozenset(
    "the and for with from that this have not are was will can all new one out use time year work file path name type user data code page list item text line word value key index table column class object test main default config setting server client request response error message string number table version module package source target image report account address application build change check common create current delete document download example field folder format function group header hello home information input install language license link local manage method model network option order output parameter password people print process product profile project property public query read record release remote result return route sample script search section select send service session size start state static status store system template token total update upload view window world write".split()
)


def _token(text: str, a: int, b: int) -> list[tuple[int, int]]:
    """The span of a token without trailing marks if it's long enough for a key; otherwise nothing."""
    own = text[a:b]
    kept = own.rstrip(".-=") if not own.endswith("=") else own
    return [(a, a + len(kept))] if len(kept) >= 16 else []


def candidates(text: str) -> list[tuple[int, int]]:
    """Spans of candidates in order: assigned values, what is left of tokens around them, others merged where they overlap."""
    spans = [m.span() for m in BLOCK.finditer(text)]
    values = []
    for m in ASSIGNED.finditer(text):
        a, b = m.span(1)
        while inner := NESTED.match(text, a, b):
            a = inner.end()
        values.append((m.start(), a, b))
    for m in ADDRESS.finditer(text):
        values.append((m.start(1), *m.span(1)))
    values.sort(key=lambda v: v[1])
    spans += [v[1:] for v in values]
    at = 0
    for m in TOKEN.finditer(text):
        a, b = m.span()
        while at < len(values) and values[at][2] <= a:
            at += 1
        if at < len(values) and a < values[at][1] < b:
            # the value reaches to the token's end or beyond
            spans += _token(text, a, max(a, values[at][0]))
            continue
        named = NAMED.match(text, a, b)
        value = _token(text, named.end(), b) if named else []
        spans += value + _token(text, *named.span(1)) if value else _token(text, a, b)
    spans.sort()
    out: list[tuple[int, int]] = []
    for a, b in spans:
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def as_scanned(findings: list[tuple]) -> list[tuple]:
    """Findings with the span of the candidate that a scan would judge in their place; the given one where none would be."""
    out = []
    for text, a, b, *rest in findings:
        shared = max(candidates(text), key=lambda s: min(b, s[1]) - max(a, s[0]), default=(b, b))
        out.append((text, *(shared if min(b, shared[1]) > max(a, shared[0]) else (a, b)), *rest))
    return out


def _kind(c: str) -> int:
    return 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3


def covered(token: str) -> float:
    """The share of a token's characters that dictionary stems of three letters or more cover, longest first."""
    low, i, n = token.lower(), 0, 0
    while i < len(low):
        for length in range(min(11, len(low) - i), 2, -1):
            if low[i : i + length] in STEMS:
                n += length
                i += length
                break
        else:
            i += 1
    return n / max(1, len(low))


def describe(text: str, a: int, b: int, path: str | None = None) -> list[float]:
    """The forest's features of the candidate ``text[a:b]`` of a document at ``path``."""
    path = (path or "").lower()
    own = text[a:b]
    kinds = [_kind(c) for c in own]
    shifts = Counter((x, y) for x, y in zip(kinds, kinds[1:], strict=False) if x != y)
    counts = Counter(own)
    n = len(own)
    before, after = text[max(0, a - CONTEXT) : a].lower(), text[b : b + CONTEXT].lower()
    near = before[-28:]
    low = own.lower()
    hexes = all(c in "0123456789abcdef-" for c in low)
    part = max(re.split(r"[/.\-_=]", own), key=len)
    own_kinds = [_kind(c) for c in part]
    return [
        float(len(own)),
        sum(shifts.values()) / n,
        (shifts[0, 2] + shifts[2, 0] + shifts[1, 2] + shifts[2, 1]) / n,
        (shifts[0, 1] + shifts[1, 0]) / n,
        -sum(v / n * math.log2(v / n) for v in counts.values()),
        kinds.count(2) / n,
        kinds.count(1) / n,
        kinds.count(3) / n,
        covered(own),
        float(own.count("/")),
        float(own.count(".")),
        float(own.count("-") + own.count("_")),
        float(hexes),
        float(bool(re.fullmatch(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}", own))),
        float(bool(PREFIX.match(own)) or own.startswith("-----BEGIN")),
        float("://" in text[max(0, a - 8) : b] or before.endswith(("@", "/")) or after.startswith(("@", "://"))),
        float(any(k in near for k in KEYWORDS)),
        float(near.rstrip(" \"'").endswith(("=", ":"))),
        float(before.endswith(('"', "'", "`")) and after.startswith(('"', "'", "`"))),
        float(any(re.search(rf"\b{k}", before) for k in BENIGN)),
        float(any(p in low for p in PLACEHOLDER)),
        float(len(counts) / n),
        max((len(m.group(0)) for m in re.finditer(r"[A-Za-z]+", own)), default=0) / n,
        float(before.endswith(":") and after.startswith("@")),
        _alternation(low),
        float(len(part)),
        sum(x != y for x, y in zip(own_kinds, own_kinds[1:], strict=False)) / len(part) if part else 0.0,
        float(any(k in path for k in SETTINGS)) - float(any(k in path for k in SAMPLES)),
    ]


def _alternation(low: str) -> float:
    """The share of neighbouring letters of which one is a vowel and the other isn't: high in words, low in keys."""
    pairs = [(x in "aeiouy", y in "aeiouy") for x, y in zip(low, low[1:], strict=False) if x.isalpha() and y.isalpha()]
    return sum(x != y for x, y in pairs) / len(pairs) if pairs else 0.0


def labelled_findings(n: int = FINDINGS, seed: int = SEED, paths: bool = False) -> list[tuple]:
    """``n`` generated findings (text, start, end, whether it's a secret, and with ``paths`` the document's path), half of
    them false alarms."""
    rng = np.random.default_rng(seed)
    pick = lambda options: options[int(rng.integers(len(options)))]
    chars = lambda alphabet, k: "".join(alphabet[i] for i in rng.integers(0, len(alphabet), k))
    lower, upper, digits = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    hexed, alnum = digits + "abcdef", lower + upper + digits
    stems = sorted(STEMS)
    uuid4 = lambda: "-".join(chars(hexed, k) for k in (8, 4, 4, 4, 12))
    words = lambda k: " ".join(pick(stems) if rng.random() < 0.4 else chars(lower, int(rng.integers(2, 10))) for _ in range(k))
    setting = ("password", "secret", "token", "api_key", "access_key", "auth_token", "client_secret", "private_key", "db_password", "bearer", "credential")
    out = []
    for i in range(n):
        real = i % 2 == 0
        quote = pick(('"', "'", "", ""))
        join = pick((" = ", "=", ": ", ":", " := "))
        if real:
            form = int(rng.integers(11))
            value = (
                "AKIA" + chars(upper + digits, 16), "ghp_" + chars(alnum, 36), "sk-" + chars(alnum, 40), chars(alnum + "+/", 40), chars(hexed, pick((32, 40, 64))),
                chars(alnum + "!#%@_-", int(rng.integers(10, 24))), "eyJ" + chars(alnum, 60) + "." + chars(alnum + "_-", 80) + "." + chars(alnum + "_-", 43), uuid4(),
                chars(lower + upper, int(rng.integers(20, 44))), chars(alnum + "!#%_-", int(rng.integers(8, 22))),
                "/".join(pick(stems) for _ in range(int(rng.integers(2, 60)))) + "/" + chars(alnum, int(rng.integers(32, 400))),
            )[form]
            named = 3 <= form < 10 or form < 3 and rng.random() < 0.6
            lead = f"{pick(setting)}{join}{quote}" if named else pick(("key ", "use ", "", "login with ", "see ", "open ")) + quote
            value = value.upper() if rng.random() < 0.05 and form in (4, 7) else value
            lead = lead.upper() if rng.random() < 0.15 else lead
            if form == 9:
                lead, quote = f"{pick(('postgres', 'mysql', 'https', 'amqp', 'redis'))}://{pick(stems)}:", f"@{pick(stems)}.{pick(('com', 'local', 'internal'))}/{pick(stems)}"
        else:
            form = int(rng.integers(17))
            value, lead = (
                lambda: (chars(hexed, pick((32, 40, 64))), pick(("sha256:", "commit ", "md5 = ", "checksum: ", "digest=\"", "etag: \"", "revision ", "integrity "))),
                lambda: (uuid4(), pick(("id: ", "uuid = ", "request ", "see ", ""))),
                lambda: ("/".join(pick(stems) for _ in range(int(rng.integers(3, 7)))) + f"/{pick(stems)}{int(rng.integers(100))}.py", pick(("file ", "path: ", "", "in "))),
                lambda: (f"{pick(stems)}{int(rng.integers(1000))}.{pick(stems)}.com/{pick(stems)}", pick(("https://", "www.", "http://", "see https://"))),
                lambda: ("_".join(pick(stems) for _ in range(int(rng.integers(3, 6)))) + str(int(rng.integers(100))), pick(("", "call ", "def ", "value = "))),
                lambda: (pick(("your_api_key_here1", "changeme12345678", "xxxxxxxxxxxxxxxx1", "EXAMPLE_TOKEN_1234", "placeholder-value-1", "insert-your-token-0")), f"{pick(setting)}{join}{quote}"),
                lambda: (chars(lower, int(rng.integers(7, 14))) + "." + str(int(rng.integers(10, 99))), ""),
                lambda: (chars(digits, int(rng.integers(16, 24))), pick(("order ", "phone ", "id ", ""))),
                lambda: (pick(stems) + pick(stems), f"{pick(setting)}{join}{pick(('process.env.', 'os.environ.', '${', 'get_'))}"),
                lambda: (chars(alnum + "+/", int(rng.integers(60, 300))), f"data:{pick(('image/png', 'image/jpeg', 'font/woff2'))};base64,"),
                lambda: (chars(alnum + "+/", pick((64, 86))) + pick(("", "==")), pick(('integrity="sha384-', 'integrity="sha512-', "integrity: sha512-", 'integrity=sha256-', 'integrity="sha1-'))),
                lambda: ("".join(chars("bcdfghjklmnpqrstvwxz", 1) + chars("aeiou", 1) for _ in range(int(rng.integers(8, 16)))), ""),
                lambda: ("".join(pick(stems).title() for _ in range(int(rng.integers(3, 6)))), pick(("class ", "new ", "", "import "))),
                lambda: ("-".join(pick(stems) if rng.random() < 0.5 else chars(lower, int(rng.integers(3, 9))) for _ in range(int(rng.integers(3, 6)))), ""),
                lambda: (pick(stems) + ("-" * int(rng.integers(14, 40))), pick(("", "---"))),
                lambda: ("_".join(pick(stems) for _ in range(int(rng.integers(2, 4)))).upper() + "=" + pick(stems) + pick(stems), pick(("", "export ", "set "))),
                lambda: ("/".join(pick(stems) for _ in range(int(rng.integers(6, 130)))) + pick(("", "/", "/a1")), pick(("see ", "open ", "in ", "https://"))),
            )[form]()
            if form == 3 and rng.random() < 0.4:
                value, lead = f"mail{int(rng.integers(10))}.example.com", chars(lower, 6) + "." + str(int(rng.integers(99))) + "@"
            quote = lead[-1] if lead.endswith(("'", '"')) else ""
        front = words(int(rng.integers(0, 9))) + pick((" ", "\n", "", " | "))
        out.append((front + lead + value + quote + " " + words(int(rng.integers(0, 8))), len(front + lead), len(front + lead + value), int(real)))
        if paths:
            # half have no telling path; settings hold more secrets, samples more false alarms
            kind = SETTINGS if rng.random() < (0.85 if real else 0.15) else SAMPLES
            out[-1] += (f"src/{pick(stems)}/{pick(kind)}" if rng.random() < 0.5 else pick(("", f"src/{pick(stems)}.py", f"{pick(stems)}.com")),)
    return as_scanned(out)


class Forest:
    """Gini trees over bootstrap samples, with a random subset of features at each split; plain arrays."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, seed: int = SEED) -> None:
        rng = np.random.default_rng(seed)
        self.trees = [self._grow(x, y, rng.integers(0, len(y), len(y)), depth, rng) for _ in range(trees)] if len(y) else []

    @staticmethod
    def _grow(x: np.ndarray, y: np.ndarray, rows: np.ndarray, depth: int, rng: np.random.Generator) -> tuple[np.ndarray, ...]:
        feature, cut, left, right, value = [], [], [], [], []

        def node(rows: np.ndarray, depth: int) -> int:
            at = len(feature)
            for column, v in ((feature, -1), (cut, 0.0), (left, 0), (right, 0), (value, float(y[rows].mean()))):
                column.append(v)
            if depth and len(rows) >= 2 * LEAST_LEAF and 0 < value[at] < 1:
                best = (1e-9, -1, 0.0)
                whole = value[at] * (1 - value[at])
                for f in rng.permutation(x.shape[1])[: int(math.sqrt(x.shape[1])) + 1]:
                    order = np.argsort(x[rows, f], kind="stable")
                    v, t = x[rows[order], f], np.cumsum(y[rows[order]])
                    n = np.arange(1, len(v))
                    p, q = t[:-1] / n, (t[-1] - t[:-1]) / (len(v) - n)
                    gain = whole - (n * p * (1 - p) + (len(v) - n) * q * (1 - q)) / len(v)
                    gain[(v[1:] == v[:-1]) | (n < LEAST_LEAF) | (len(v) - n < LEAST_LEAF)] = 0
                    k = int(gain.argmax())
                    if gain[k] > best[0]:
                        best = (gain[k], int(f), (v[k] + v[k + 1]) / 2)
                if best[1] >= 0:
                    feature[at], cut[at] = best[1], best[2]
                    goes = x[rows, best[1]] <= best[2]
                    left[at] = node(rows[goes], depth - 1)
                    right[at] = node(rows[~goes], depth - 1)
            return at

        node(rows, depth)
        return np.array(feature), np.array(cut), np.array(left), np.array(right), np.array(value)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for feature, cut, left, right, value in self.trees:
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH + 1):
                f = feature[at]
                inner = f >= 0
                if not inner.any():
                    break
                goes = x[np.arange(len(x)), np.maximum(f, 0)] <= cut[at]
                at = np.where(inner, np.where(goes, left[at], right[at]), at)
            total += value[at]
        return total / max(1, len(self.trees))


def train(findings: list[tuple] | None = None) -> Forest:
    """A forest from labelled findings: (text, start, end, label), and the document's path if it's known."""
    findings = labelled_findings(paths=True) if findings is None else as_scanned(findings)
    x = np.array([describe(t, a, b, *path) for t, a, b, _, *path in findings])
    return Forest(x, np.array([f[3] for f in findings], float))


def judged(model: Forest, texts: list[str | None], paths: list[str | None] | None = None) -> list[list[tuple[int, int, float]]]:
    """For each text its candidates (start, end, score)."""
    spans = [candidates(t) if t else [] for t in texts]
    x = [describe(t, a, b, p) for t, own, p in zip(texts, spans, paths or [None] * len(texts), strict=True) for a, b in own]
    scores = iter(model.score(np.array(x)).tolist() if x else [])
    return [[(a, b, next(scores)) for a, b in own] for own in spans]


FINDING = "array<struct<start:long,length:long,score:double,is_secret:boolean,value_sha256:string>>"


def scan_documents(documents: DataFrame, model: Forest | None = None) -> DataFrame:
    """``doc_id, n_candidates, n_secrets, findings``: one row per document, offsets in code points."""
    spark = documents.sparkSession
    C.small_batches(spark)
    shared = spark.sparkContext.broadcast(model or train())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for batch in batches:
            texts = batch.column("text").to_pylist()
            found = judged(shared.value, texts, batch.column("path").to_pylist())
            rows = [[{"start": a, "length": b - a, "score": s, "is_secret": s >= THRESHOLD, "value_sha256": hashlib.sha256(t[a:b].encode()).hexdigest()} for a, b, s in own] for t, own in zip(texts, found, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(r) for r in rows], pa.int64()), pa.array([sum(f["is_secret"] for f in r) for r in rows], pa.int64()), pa.array(rows, _FINDING)],
                ["doc_id", "n_candidates", "n_secrets", "findings"],
            )

    path = next((C.quoted(c).cast("string") for c in ("path", "source") if c in documents.columns), F.lit(None).cast("string"))
    own = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), path.alias("path"))
    return own.mapInArrow(C.tidy(run), f"doc_id long, n_candidates long, n_secrets long, findings {FINDING}")


_FINDING = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("score", pa.float64()), ("is_secret", pa.bool_()), ("value_sha256", pa.string())]))


def mask_secrets(documents: DataFrame, model: Forest | None = None, mask: str = "[secret]") -> DataFrame:
    """``documents`` with every confirmed secret in ``text`` replaced by ``mask``; all rows and columns stay."""
    spark = documents.sparkSession
    C.small_batches(spark)
    shared = spark.sparkContext.broadcast(model or train())
    at = documents.columns.index("text")
    where = next((documents.columns.index(c) for c in ("path", "source") if c in documents.columns), None)

    def clean(text: str | None, found: list[tuple[int, int, float]]) -> str | None:
        for a, b, s in reversed(found):
            if s >= THRESHOLD:
                text = text[:a] + mask + text[b:]
        return text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            paths = None if where is None else [None if p is None else str(p) for p in batch.column(where).to_pylist()]
            out = [clean(t, f) for t, f in zip(texts, judged(shared.value, texts, paths), strict=True)]
            yield batch.set_column(at, batch.schema.field(at), pa.array(out, batch.column(at).type))

    return C.map_rows(documents, run)
