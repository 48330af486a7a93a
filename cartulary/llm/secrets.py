"""Secret scan: pattern candidates, and a random forest that removes false positives."""

from __future__ import annotations

import bisect
import hashlib
import random
import re
import string
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartulary.llm import textbuf
from cartulary.llm.trees import Forest
from cartulary.llm.workspace import lean

THRESHOLD = 0.5
#: Letters in a run that is a candidate without a telling word before it.
LEAST_RUN = 20
#: Bytes around a candidate whose words count.
NEAR = 48
MASK = b"<secret>"

#: Letters of words that the dictionary may hold, the hash buckets in which all such words of the corpus are counted, and the share of them all that makes a bucket's words the dictionary's.
LETTERS = (4, 12)
BUCKETS = 1 << 18
FREQUENT = 1 / 20_000
#: Hash buckets of the words before and after a candidate.
NEIGHBOURS = 24
#: Labelled findings, by hash, on which the forest is fitted at most.
LABELS = 50_000

# Words of the assignment rule and of the neighbourhood, words that generated findings are made of, prefixes of known token kinds.
KEYS = "token secret password passwd passphrase pwd apikey api_key api-key access_key access-key accesskey private_key client_secret auth authorization bearer credential credentials signing_key encryption_key"
HARMLESS = "example sample dummy placeholder test testing fake mock checksum sha1 sha256 md5 hash digest commit revision uuid guid version href src class id isbn doi integrity etag"
WORDS = "about after again also apple because before being between build change class client code color config content could count create data date default delete document down each email error example field file find first font form from function group hello help here home house image index info input into item just key know large light line link list local long made main make many message method more most name network next null number object only option other over page param part password path people place placeholder point port print project public query read report request result return right sample scale school script search secret select server service set short should show simple size small source space start state string style table team test text that them then there these thing this time title token type under update user value version very view water well what when where which while white will with word work world would write year your"
PREFIXES = r"AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_(?:live|test)_[A-Za-z0-9]{16,}|AIza[0-9A-Za-z_-]{35}|eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"

_KEY_BEFORE = re.compile(rb"(?:" + "|".join(sorted(KEYS.split(), key=len, reverse=True)).encode() + rb")[\"'\]]?[ \t]*[:=][ \t]*[\"'`]?$", re.I)
_KEY_NEAR = re.compile(rb"(?:" + b"|".join(re.escape(x.encode()) for x in KEYS.split()) + rb")", re.I)
_HARMLESS_NEAR = re.compile(rb"\b(?:" + b"|".join(x.encode() for x in HARMLESS.split()) + rb")\b", re.I)
_KNOWN = re.compile(rb"^(?:" + PREFIXES.encode() + rb")$")
_VALUE = re.compile(rb"[^\s\"'`,;<>(){}\[\]]{6,}")
_TEST_PATH = re.compile(r"(?:^|[^a-z])(?:tests?|examples?|samples?|fixtures?|docs?|demo|mock)(?:[^a-z]|$)", re.I)
_BEGIN, _END = re.compile(rb"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"), re.compile(rb"-----END [A-Z ]{0,40}PRIVATE KEY-----")
_WORD = re.compile(rb"[a-z]+")

_RUN = np.zeros(256, bool)
_RUN[[ord(c) for c in string.ascii_letters + string.digits + "+/_=-."]] = True
_KIND = np.zeros(256, np.int64)
_KIND[97:123], _KIND[65:91], _KIND[48:58] = 1, 2, 3
_DIGIT = _KIND == 3
FEATURES = ("length", "digits", "capitals", "small letters", "kinds of characters", "changes of kind", "entropy", "hexadecimal", "rare transitions", "dictionary", "key before", "key near", "harmless near", "known form", "in a path", "test path", "block", "repeats", *(f"neighbour {k}" for k in range(NEIGHBOURS)))


def candidates(chunk: textbuf.Chunk) -> list[tuple[int, int, int, str]]:
    """(document, start, end, rule) of what may be a secret, as bytes of the chunk; spans of a document do not overlap."""
    data, offsets = chunk.data, chunk.offsets
    raw = data.tobytes()
    found: list[tuple[int, int, int, int, str]] = []
    doc_of = lambda at: int(np.searchsorted(offsets, at, "right")) - 1
    for at in np.flatnonzero((data == 0x3D) | (data == 0x3A)).tolist():
        d = doc_of(at)
        low, high = int(offsets[d]), int(offsets[d + 1])
        stop = at + 1
        while stop < high and stop < at + 4 and raw[stop] in b" \t\"'`":
            stop += 1
        if _KEY_BEFORE.search(raw, max(low, at - NEAR), stop) and (m := _VALUE.match(raw, stop, high)):
            found.append((d, m.start(), m.end(), 0, "assignment"))
    run = _RUN[data]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], run, [False]]).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    digits = np.concatenate([[0], np.cumsum(_DIGIT[data])])
    long = (ends - starts >= LEAST_RUN) & (digits[ends] > digits[starts])
    for a, b in zip(starts[long].tolist(), ends[long].tolist()):
        for d in range(doc_of(a), doc_of(b - 1) + 1):  # a run may reach over the end of a document
            x, y = max(a, int(offsets[d])), min(b, int(offsets[d + 1]))
            if y - x >= LEAST_RUN and digits[y] > digits[x]:
                found.append((d, x, y, 1, "known form" if _KNOWN.match(raw[x:y]) else "long run"))
    ends = [(m.start(), m.end()) for m in _END.finditer(raw)]
    for m in _BEGIN.finditer(raw):
        d = doc_of(m.start())
        k = bisect.bisect_left(ends, (m.end(),))
        if k < len(ends) and ends[k][1] <= offsets[d + 1]:
            found.append((d, m.start(), ends[k][1], -1, "private key"))
    found.sort(key=lambda x: (x[0], x[3], x[1], x[2]))
    # Spans that were kept never overlap, so only the neighbours of a new one can.
    starts, out, last = [], [], -1
    stops: dict[int, int] = {}
    for d, a, b, _, rule in found:
        if d != last:
            starts, stops, last = [], {}, d
        k = bisect.bisect_left(starts, a)
        if (k == 0 or stops[starts[k - 1]] <= a) and (k == len(starts) or starts[k] >= b):
            starts.insert(k, a)
            stops[a] = b
            out.append((d, a, b, rule))
    return sorted(out)


def _buckets(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return (textbuf.hashes(data, starts, ends) & np.uint64(BUCKETS - 1)).astype(np.int64)


def _words_counted(chunk: textbuf.Chunk) -> np.ndarray:
    """In each bucket, how many runs of small or capital letters of the right length the chunk's documents have."""
    letter = (_KIND[chunk.data] == 1) | (_KIND[chunk.data] == 2)
    edge = np.diff(np.concatenate([[False], letter, [False]]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    # A run over the end of a document is two words: it is left out, whatever documents meet in a chunk.
    whole = np.searchsorted(chunk.offsets, starts, "right") == np.searchsorted(chunk.offsets, ends, "left")
    whole &= (ends - starts >= LETTERS[0]) & (ends - starts <= LETTERS[1])
    inner = np.isin(starts[whole], chunk.offsets) | np.isin(ends[whole], chunk.offsets)
    starts, ends = starts[whole][~inner], ends[whole][~inner]
    return np.bincount(_buckets(chunk.data, starts, ends), minlength=BUCKETS) if len(starts) else np.zeros(BUCKETS, np.int64)


class Corpus:
    """What all texts say of bytes and words: the cost of each byte after each other, and the buckets of frequent words."""

    def __init__(self, pairs: np.ndarray, words: np.ndarray):
        total = pairs.reshape(256, 256) + 0.5
        self.costs = np.log2(total.sum(axis=1, keepdims=True) / total)
        self.frequent = words > FREQUENT * max(1, words.sum())

    def covered(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The share of each span that words of the dictionary cover."""
        length = ends - starts
        span = np.repeat(np.arange(len(starts)), length)
        at = starts[span] + np.arange(len(span)) - np.repeat(np.cumsum(length) - length, length)
        edge = np.zeros(len(data) + 1, np.int64)
        letter = np.concatenate([[0], np.cumsum((_KIND[data] == 1) | (_KIND[data] == 2))])
        for n in range(LETTERS[0], LETTERS[1] + 1):
            inside = at + n <= ends[span]
            a = at[inside]
            a = a[letter[a + n] - letter[a] == n]
            if len(a):
                a = a[self.frequent[_buckets(data, a, a + n)]]
                np.add.at(edge, a, 1)
                np.add.at(edge, a + n, -1)
        under = np.concatenate([[0], np.cumsum(np.cumsum(edge[:-1]) > 0)])
        return (under[ends] - under[starts]) / np.maximum(length, 1)


def _neighbours(before: bytes, after: bytes) -> list[float]:
    """How many words before, in the first half, and after fall into each bucket."""
    out = [0.0] * NEIGHBOURS
    half = NEIGHBOURS // 2
    for k, text in ((0, before), (half, after)):
        for word in _WORD.findall(text.lower()):
            out[k + zlib.crc32(word) % half] += 1
    return out


def _features(value: bytes, before: bytes, after: bytes, path: str, costs: np.ndarray, covered: float) -> list[float]:
    """FEATURES of a candidate; costs: of each byte after each other; covered: its share of letters in words of the dictionary."""
    v = np.frombuffer(value, np.uint8)
    n = max(1, len(v))
    kind = _KIND[v]
    count = np.bincount(kind, minlength=4)
    share = np.bincount(v, minlength=256)
    share = share[share > 0] / n
    pairs = costs[v[:-1], v[1:]].mean() if len(v) > 1 else 0.0
    return [
        min(n, 400), count[3] / n, count[2] / n, count[1] / n, float((count > 0).sum()), float((kind[1:] != kind[:-1]).sum()) / n, float(-(share * np.log2(share)).sum()), float(re.fullmatch(rb"[0-9a-fA-F-]+", value) is not None), float(pairs),
        covered, float(_KEY_BEFORE.search(before) is not None), float(_KEY_NEAR.search(before) is not None), float(_HARMLESS_NEAR.search(before) is not None or _HARMLESS_NEAR.search(after) is not None), float(_KNOWN.match(value) is not None),
        float(before[-1:] in b"/." and before != b"" or b"/" in value[1:] and b"." in value), float(_TEST_PATH.search(path) is not None), float(value.startswith(b"-----BEGIN")), 1 - len(set(value[i : i + 4] for i in range(max(1, n - 3)))) / max(1, n - 3), *_neighbours(before, after),
    ]


def corpus_of(docs: DataFrame) -> Corpus:
    """From all texts, and alike however they are dealt: pairs and words never reach over the end of a document."""

    @textbuf.frugal
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, words = np.zeros(1 << 16, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for chunk in textbuf.chunks(batch.column(0)):
                d = chunk.data.astype(np.uint16)
                keep = np.ones(max(0, len(d) - 1), bool)
                inner = chunk.offsets[(chunk.offsets > 0) & (chunk.offsets < len(d))]
                keep[inner - 1] = False
                pairs += np.bincount((d[:-1] << 8 | d[1:])[keep], minlength=1 << 16)
                words += _words_counted(chunk)
        for kind, total in ((0, pairs), (1, words)):
            used = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(used), kind, np.int32)), pa.array(used), pa.array(total[used])], ["kind", "key", "n"])

    pairs, words = np.zeros(1 << 16), np.zeros(BUCKETS)
    sums = docs.select("text").mapInArrow(count, "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))
    for batch in sums.toArrow().to_batches():  # at most a row per pair and per bucket
        kind, key, n = (batch.column(c).to_numpy() for c in ("kind", "key", "n"))
        pairs[key[kind == 0]], words[key[kind == 1]] = n[kind == 0], n[kind == 1]
    return Corpus(pairs, words)


def example_findings(n: int = 1500, seed: int = 11) -> list[tuple[bytes, bytes, bytes, str, int]]:
    """Labelled findings (value, before, after, path, secret) for those who bring none: tokens as services issue them, and what is mistaken for them."""
    rng = random.Random(seed)
    words, keys, harmless = WORDS.split(), KEYS.split(), HARMLESS.split()
    take = lambda chars, k: "".join(rng.choice(chars) for _ in range(k))
    hexes, alnum = "0123456789abcdef", string.ascii_letters + string.digits
    prose = lambda: " ".join(rng.choice(words) for _ in range(4)) + " "
    camel = lambda k: "".join(rng.choice(words).title() for _ in range(k))
    out = []
    for _ in range(n):
        value = rng.choice([lambda: take(hexes, rng.choice([32, 40, 64])), lambda: take(alnum, rng.randint(20, 64)), lambda: take(alnum + "+/", 40), lambda: "AKIA" + take(string.ascii_uppercase + string.digits, 16), lambda: "ghp_" + take(alnum, 36), lambda: "sk_live_" + take(alnum, 24), lambda: take(alnum + "!@#$%^&*", rng.randint(8, 20))])()
        quote = rng.choice(["", '"', "'"])
        bare = _KNOWN.match(value.encode()) is not None and rng.random() < 0.5
        before = prose() if bare else prose() + rng.choice(keys) + rng.choice([" = ", "=", ": ", ":"]) + quote
        out.append((value.encode(), before.encode(), (quote + " " + prose()).encode(), rng.choice(["", "src1", "blog", "config/app.yml"]), 1))
        kind = rng.randrange(7)
        value, before, after = [
            lambda: (take(hexes, rng.choice([32, 40, 64])), prose() + rng.choice(harmless) + rng.choice([" ", ": ", "="]), " " + prose()),
            lambda: (camel(4) + str(rng.randint(1, 99)), prose(), " " + prose()),
            lambda: ("-".join(take(hexes, k) for k in (8, 4, 4, 4, 12)), prose() + "id=", " " + prose()),
            lambda: ("/".join(rng.choice(words) for _ in range(4)) + f"/{rng.randint(1, 9999)}.html", prose() + "https:/", " " + prose()),
            lambda: (rng.choice(["your_" + rng.choice(words) + "_here", "xxxxxxxxxxxx", "changeme123", "<placeholder>", "0" * 24, "example_" + rng.choice(words), rng.choice(words) + "_" + rng.choice(words)]), prose() + rng.choice(keys) + " = ", " " + prose()),
            lambda: (".".join(rng.choice(words) for _ in range(3)) + f".{rng.randint(10, 99)}", prose(), " " + prose()),
            lambda: ("_".join(rng.choice(words) for _ in range(4)) + f"_{rng.randint(1, 9)}", prose(), "() " + prose()),
        ][kind]()
        out.append((value.encode(), before.encode(), after.encode(), rng.choice(["", "src1", "tests/unit.py", "docs/example.md"]), 0))
    return out


def _table(found: list[tuple[bytes, bytes, bytes, str]], corpus: Corpus) -> np.ndarray:
    """A row of FEATURES for each finding (value, before, after, path)."""
    data = np.frombuffer(b"".join(f[0] for f in found), np.uint8)
    ends = np.cumsum([len(f[0]) for f in found])
    covered = corpus.covered(data, ends - [len(f[0]) for f in found], ends)
    return np.array([_features(*f, corpus.costs, float(c)) for f, c in zip(found, covered)]).reshape(-1, len(FEATURES))


def train(corpus: Corpus, labelled: DataFrame | list[tuple[bytes, bytes, bytes, str, int]] | None) -> Forest:
    """The forest of labelled findings: rows, or a table with columns value, before, after (strings or bytes), path and secret (0 or 1), of which at most LABELS rows are used."""
    if isinstance(labelled, DataFrame):
        rows = labelled.select(*(F.coalesce(F.col(c).cast("binary"), F.lit(b"")).alias(c) for c in ("value", "before", "after")), F.coalesce("path", F.lit("")).alias("path"), F.col("secret").cast("int").alias("secret")).where("secret is not null")
        labelled = [(bytes(r[0]), bytes(r[1]), bytes(r[2]), r[3], r[4]) for r in rows.orderBy(F.xxhash64("value", "before", "after"), "value", "before", "after", "path", "secret").limit(LABELS).collect()]
    elif labelled is None:
        labelled = example_findings()
    labelled = [x for x in labelled if x[0]]
    return Forest(_table([(v, b[-NEAR:], a[:NEAR], p) for v, b, a, p, _ in labelled], corpus) if labelled else np.empty((0, len(FEATURES))), np.array([r[4] for r in labelled], float))


def _judged(chunk: textbuf.Chunk, paths: list[str], forest: Forest, corpus: Corpus) -> list[tuple[int, int, int, str, float]]:
    found = candidates(chunk)
    out = []
    for k in range(0, len(found), 5000):
        rows = []
        for d, a, b, _ in found[k : k + 5000]:
            low, high = int(chunk.offsets[d]), int(chunk.offsets[d + 1])
            rows.append((chunk.data[a:b].tobytes(), chunk.data[max(low, a - NEAR) : a].tobytes(), chunk.data[b : min(high, b + NEAR)].tobytes(), paths[d]))
        out += [(*f, float(s)) for f, s in zip(found[k : k + 5000], forest.of(_table(rows, corpus)))]
    return out


def scan(docs: DataFrame, *, labelled: DataFrame | list | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """A row per candidate: doc_id, start and length in bytes, rule, sha256 of the value, score, is_secret.

    docs needs doc_id, text and source (the path of the text); other columns are
    ignored.  Null texts have no candidates, a null source is an empty path, a null
    doc_id stays null; whole texts are scanned, also very long ones; repeated rows
    give repeated findings; an empty table gives none.  labelled: see train();
    without it generated findings are learned from.  If it is empty nothing can be
    told apart: all candidates have score 0.5, which is at the threshold.
    """
    docs = lean(docs)
    corpus = corpus_of(docs)
    forest = train(corpus, labelled)

    @textbuf.frugal
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, paths = batch.column(0), [p or "" for p in batch.column(2).to_pylist()]
            for chunk in textbuf.chunks(batch.column(1)):
                rows = _judged(chunk, paths[chunk.first : chunk.first + chunk.n], forest, corpus)
                at = pa.array([chunk.first + r[0] for r in rows], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [ids.take(at), pa.array([r[1] - int(chunk.offsets[r[0]]) for r in rows], pa.int64()), pa.array([r[2] - r[1] for r in rows], pa.int64()), pa.array([r[3] for r in rows], pa.string()), pa.array([hashlib.sha256(chunk.data[r[1] : r[2]].tobytes()).hexdigest() for r in rows], pa.string()), pa.array([r[4] for r in rows], pa.float64()), pa.array([r[4] >= threshold for r in rows], pa.bool_())],
                    ["doc_id", "start", "length", "rule", "value_sha256", "score", "is_secret"],
                )

    return docs.select("doc_id", "text", "source").mapInArrow(find, "doc_id long, start long, length long, rule string, value_sha256 string, score double, is_secret boolean")


def redact(docs: DataFrame, *, labelled: DataFrame | list | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """docs with each secret replaced by a mask, and n_chars to match.

    All rows and columns stay, repeated ones and those without a doc_id too; null
    texts stay null, a null source is an empty path, texts of any length are masked
    whole; an empty table stays empty.  labelled: see scan().
    """
    docs = lean(docs)
    corpus = corpus_of(docs)
    forest = train(corpus, labelled)
    names = docs.columns
    at, source = names.index("text"), names.index("source")

    @textbuf.frugal
    def mask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths = [p or "" for p in batch.column(source).to_pylist()]
            texts: dict[int, list[bytes]] = {}
            for chunk in textbuf.chunks(batch.column(at)):
                done: dict[int, int] = {}
                for d, a, b, _, score in _judged(chunk, paths[chunk.first : chunk.first + chunk.n], forest, corpus):
                    if score >= threshold:
                        texts.setdefault(chunk.first + d, []).extend((chunk.data[done.get(d, int(chunk.offsets[d])) : a].tobytes(), MASK))
                        done[d] = b
                for d, b in done.items():
                    texts[chunk.first + d].append(chunk.data[b : int(chunk.offsets[d + 1])].tobytes())
            if texts:
                new = pa.array([b"".join(texts[i]).decode("utf-8", "replace") if i in texts else None for i in range(batch.num_rows)], pa.string())
                batch = batch.set_column(at, pa.field("text", pa.string()), pc.if_else(pa.array([i in texts for i in range(batch.num_rows)]), new, batch.column(at)))
            yield batch

    out = docs.mapInArrow(mask, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in names else out
