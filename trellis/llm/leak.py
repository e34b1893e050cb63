"""Evaluation texts that leak into training text (problem 9): latent semantic retrieval.

Passages are windows of words weighted by TF-IDF; document frequencies are counted
over the whole corpus. A randomised SVD (Gaussian sketch and one power iteration,
summed over the partitions) of the passages of all documents, with those of the
evaluation texts put under them at TEXT_WEIGHT times their energy, gives the latent
space; without that weight the leading directions are those of the corpus's common
words and the rare names that tell a passage are lost. Windows of documents whose latent cosine to a window of an evaluation text
reaches COSINE make the pair a candidate. So does a run of RUN equal words: no case is
without one, so what lies under COSINE, or outside of a space of RANK, is not lost. The
longest common subsequence with few edits then settles every candidate over the whole document.

Scale: evaluation texts are taken in blocks of TEXTS_AT_ONCE rows, whose words, latent vectors
and runs are broadcast; documents are read once, kept as word hashes, and never shuffled. Windows
whose latent vector is too short to reach COSINE with anything are dropped, the rest is compared
with the evaluation windows of its PROBES nearest centroids, so the work grows with the root of
their number. What comes to the driver is bounded by the block and not by the corpus: the document
frequencies of its words, those of all other words in BUCKETS sums, and a matrix of words x RANK.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trellis.llm import align
from trellis.session import cut, spread_few

BUCKETS, RANK, OVERSAMPLE = 1 << 18, 176, 16
TEXT_WEIGHT = 16.0
DOC_WINDOW, DOC_STEP, TEXT_WINDOW, TEXT_STEP = 16, 5, 24, 8
COSINE = 0.42
#: A passage of n >= 16 words with e <= n / 8 edits has at least n - e equal words in at most e + 1 runs,
#: so one run has at least (n - e) / (e + 1) of them: over 4 at 16 words with 2 edits, more in any longer passage.
RUN = 5
#: Evaluation rows that are broadcast together; more of them are taken in blocks.
TEXTS_AT_ONCE = 5_000
#: Centroids of evaluation windows that a document's window is compared with.
PROBES = 8
_SEED = 7


def word_hashes(text: str | None) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(w) for w in align.words_of(text)], np.uint64).view(np.int64)


def _hash_docs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    memo: dict[str, int] = {}
    for pdf in batches:
        out = []
        for text in pdf["text"]:
            ids = []
            for w in align.words_of(text):
                h = memo.get(w)
                if h is None:
                    h = int(np.uint64(xxhash.xxh3_64_intdigest(w)).view(np.int64))
                    if len(memo) < 500_000:
                        memo[w] = h
                ids.append(h)
            out.append(np.array(ids, np.int64))
        yield pd.DataFrame({"doc_id": pdf["doc_id"], "words": out})


def _bucket(h: np.ndarray) -> np.ndarray:
    return (h & (BUCKETS - 1)).astype(np.int64)


def _frequencies(vocabulary: np.ndarray):
    """In how many documents each word of the vocabulary stands; of other words those of each bucket together."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, rest, docs = np.zeros(len(vocabulary), np.int64), np.zeros(BUCKETS, np.int64), 0
        for pdf in batches:
            for words in pdf["words"]:
                w = np.unique(np.asarray(words, np.int64))
                at = _column(vocabulary, w)
                own[at[at >= 0]] += 1
                np.add.at(rest, _bucket(w[at < 0]), 1)
                docs += 1
        a, b = np.flatnonzero(own), np.flatnonzero(rest)
        yield pd.DataFrame({"i": np.concatenate([a, b + len(own), [-1]]), "n": np.concatenate([own[a], rest[b], [docs]])})

    return run


def _column(vocabulary: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Place of each word in the sorted vocabulary, -1 for those outside."""
    if not len(vocabulary):
        return np.full(len(words), -1)
    at = np.minimum(np.searchsorted(vocabulary, words), len(vocabulary) - 1)
    return np.where(vocabulary[at] == words, at, -1)


class Space:
    """Words of the evaluation texts, their weights, and the basis of the latent space."""

    def __init__(self, vocabulary: np.ndarray, frequency: np.ndarray, docs: int):
        self.vocabulary = vocabulary
        self.idf = (np.log((docs + 1) / (frequency + 1)) + 0.1).astype(np.float32)
        self.basis = np.zeros((len(vocabulary), 0), np.float32)

    def columns(self, words: np.ndarray) -> np.ndarray:
        """Column of each word, -1 for those outside of the evaluation texts."""
        return _column(self.vocabulary, words)

    def weights(self, words: np.ndarray, columns: np.ndarray) -> np.ndarray:
        return self.idf[np.where(columns >= 0, columns, len(self.vocabulary) + _bucket(words))]

    def windows(self, words: np.ndarray, size: int, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts of the windows, the columns of all words and their weights; the last window ends with the text."""
        starts = np.arange(0, max(1, len(words) - size + 1), step)
        if starts[-1] + size < len(words):
            starts = np.append(starts, len(words) - size)
        cols = self.columns(words)
        return starts, cols, self.weights(words, cols)

    def latent(self, words: np.ndarray, size: int, step: int, basis: np.ndarray) -> np.ndarray:
        """Latent vectors of the windows, divided by the full TF-IDF norms, so that products are cosines at most."""
        starts, cols, idf = self.windows(words, size, step)
        rows = np.where(cols[:, None] >= 0, basis[np.maximum(cols, 0)], 0) * idf[:, None]
        ends = np.minimum(starts + size, len(words))
        total = np.concatenate([np.zeros((1, rows.shape[1])), np.cumsum(rows, axis=0, dtype=np.float64)])
        norm = np.concatenate([[0.0], np.cumsum(idf.astype(np.float64) ** 2)])
        return ((total[ends] - total[starts]) / np.sqrt(norm[ends] - norm[starts])[:, None]).astype(np.float32)

    def gram_times(self, docs: Iterator[np.ndarray], right: np.ndarray) -> np.ndarray:
        """A'A times ``right``, A being the TF-IDF passages (disjoint windows) of the documents; a last row holds the trace of A'A."""
        out, right = np.zeros((len(right) + 1, right.shape[1])), right.astype(np.float32)
        held, at = [], 0
        for words in docs:
            for i in range(0, len(words), TEXT_WINDOW):
                part = words[i : i + TEXT_WINDOW]
                held.append(part)
                at += len(part)
            if at > 30_000:
                self._add(held, right, out)
                held, at = [], 0
        self._add(held, right, out)
        return out

    def _add(self, passages: list[np.ndarray], right: np.ndarray, out: np.ndarray) -> None:
        if not passages:
            return
        words = np.concatenate(passages)
        part = np.repeat(np.arange(len(passages)), [len(p) for p in passages])
        cols = self.columns(words)
        idf = self.weights(words, cols)
        norm = np.sqrt(np.bincount(part, idf.astype(np.float64) ** 2, len(passages))).astype(np.float32)
        keep = cols >= 0
        c, p, v = cols[keep], part[keep], (idf[keep] / norm[part[keep]])[:, None]
        if not len(c):
            return
        out[-1] += float((v**2).sum())
        y = np.zeros((len(passages), right.shape[1]), np.float32)
        first = np.flatnonzero(np.r_[True, p[1:] != p[:-1]])
        y[p[first]] = np.add.reduceat(right[c] * v, first, axis=0)
        order = np.argsort(c, kind="stable")
        c, p, v = c[order], p[order], v[order]
        first = np.flatnonzero(np.r_[True, c[1:] != c[:-1]])
        out[c[first]] += np.add.reduceat(y[p] * v, first, axis=0)


def _sum_matrix(tokens: DataFrame, space: Space, right: np.ndarray) -> np.ndarray:
    """Space.gram_times over all documents; one partial matrix per partition, added up by rows."""
    shared = tokens.sparkSession.sparkContext.broadcast((space, right))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        s, r = shared.value
        got = s.gram_times((np.asarray(w, np.int64) for pdf in batches for w in pdf["words"]), r)
        yield pd.DataFrame({"i": np.arange(len(got)), "row": list(got)})

    # there is a partial matrix per partition, so partitions are as many as the cluster's cores ask for, not the data
    spread = 4 * tokens.sparkSession.sparkContext.defaultParallelism
    parts = tokens.select("words").coalesce(spread).mapInPandas(run, "i bigint, row array<double>")
    each = parts.groupBy("i").agg(vector_to_array(Summarizer.sum(array_to_vector("row"))).alias("row")).toArrow()
    out = np.zeros((len(right) + 1, right.shape[1]))
    if len(each):
        out[each.column("i").to_numpy()] = each.column("row").combine_chunks().flatten().to_numpy().reshape(len(each), -1)
    return out


class Centroids:
    """Evaluation windows by their nearest of as many centroids as the root of their number."""

    def __init__(self, queries: np.ndarray, owner: np.ndarray, rounds: int = 6):
        self.queries, self.owner = queries, owner
        unit = queries / np.maximum(np.linalg.norm(queries, axis=1, keepdims=True), 1e-9)
        k = max(1, int(np.sqrt(len(queries))))
        c = unit[np.random.default_rng(_SEED).choice(len(unit), k, replace=False)]
        for _ in range(rounds):
            near = (unit @ c.T).argmax(axis=1)
            sums = np.zeros_like(c)
            np.add.at(sums, near, unit)
            size = np.linalg.norm(sums, axis=1, keepdims=True)
            c = np.where(size > 1e-9, sums / np.maximum(size, 1e-9), c)
        near = (unit @ c.T).argmax(axis=1)
        self.centres, self.lists = c, [np.flatnonzero(near == i) for i in range(k)]

    def search(self, z: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
        """Rows of z and indices of texts one of whose windows reaches the cosine."""
        # no product can be larger than the vector is long
        keep = np.flatnonzero(np.linalg.norm(z, axis=1) >= cosine)
        near = z[keep] @ self.centres.T
        probes = min(PROBES, near.shape[1])
        top = np.argpartition(-near, probes - 1, axis=1)[:, :probes]
        rows, texts = [np.empty(0, int)], [np.empty(0, int)]
        for c in np.unique(top):
            mine, list_ = keep[(top == c).any(axis=1)], self.lists[c]
            p, q = np.nonzero(z[mine] @ self.queries[list_].T >= cosine)
            rows.append(mine[p]), texts.append(self.owner[list_[q]])
        return np.concatenate(rows), np.concatenate(texts)


def runs_of(words: np.ndarray) -> np.ndarray:
    """Hashes of all runs of RUN words, in order."""
    w, n = words.view(np.uint64), max(0, len(words) - RUN + 1)
    out = np.zeros(n, np.uint64)
    for j in range(RUN):
        out = out * np.uint64(0x9E3779B97F4A7C15) + w[j : j + n]
    return out


class Runs:
    """Which texts hold each run of RUN words."""

    def __init__(self, texts: list[np.ndarray]):
        each = [np.unique(runs_of(t)) for t in texts]
        keys = np.concatenate([*each, np.empty(0, np.uint64)])
        owner = np.repeat(np.arange(len(texts), dtype=np.int32), [len(e) for e in each])
        order = np.argsort(keys, kind="stable")
        self.keys, first = np.unique(keys[order], return_index=True)
        self.owner, self.ends = owner[order], np.append(first, len(keys))

    def texts(self, words: np.ndarray) -> set[int]:
        """Indices of the texts that share a run with the document."""
        if not len(self.keys):
            return set()
        runs = runs_of(words)
        at = np.minimum(np.searchsorted(self.keys, runs), len(self.keys) - 1)
        hit = np.unique(at[self.keys[at] == runs])
        return {k for h in hit.tolist() for k in self.owner[self.ends[h] : self.ends[h + 1]].tolist()}


def fit(tokens: DataFrame, texts: list[np.ndarray], rank: int = RANK) -> Space:
    """Document frequencies and the randomised SVD over all documents."""
    vocabulary = np.unique(np.concatenate(texts)) if texts else np.empty(0, np.int64)
    got = tokens.select("words").mapInPandas(_frequencies(vocabulary), "i bigint, n bigint").groupBy("i").agg(F.sum("n").alias("n")).toArrow()
    at, count = got.column("i").to_numpy(), got.column("n").to_numpy()
    frequency = np.zeros(len(vocabulary) + BUCKETS)
    frequency[at[at >= 0]] = count[at >= 0]
    space = Space(vocabulary, frequency, int(count[at < 0].sum()))
    n = len(space.vocabulary)
    width = min(n, rank + OVERSAMPLE)
    # every third of a window apart, so that each run of words lies well inside of one
    own = [t[i : i + TEXT_WINDOW] for t in texts for i in range(0, max(1, len(t) - TEXT_WINDOW + 1), TEXT_STEP)]

    def times(right: np.ndarray) -> np.ndarray:
        """A'A times ``right`` for the passages of corpus and evaluation texts, each part at its share of the energy."""
        corpus, mine = _sum_matrix(tokens, space, right), space.gram_times(iter(own), right)
        return corpus[:-1] / max(corpus[-1, 0], 1e-9) + TEXT_WEIGHT * mine[:-1] / max(mine[-1, 0], 1e-9)

    sketch = np.random.default_rng(_SEED).standard_normal((n, width))
    q, _ = np.linalg.qr(times(sketch))
    b = times(q)
    # the eigenvectors of A'A within the sketched range
    small = q.T @ b
    w, u = np.linalg.eigh((small + small.T) / 2)
    space.basis = (q @ u[:, np.argsort(-w)[:rank]]).astype(np.float32)
    return space


#: Of a passage some block of m >= 16 words has at most m / 8 edits, so at least m - m // 8 of its words lie in at most m + m // 8
#: words of the document; in some NEAR consecutive ones of these there are at least HITS words of the text.
NEAR, HITS = 18, 14


def may_hold(vocabulary: np.ndarray, words: np.ndarray) -> bool:
    """Whether a document has enough words of a text close together; no case is without them."""
    sums = np.concatenate([[0], np.cumsum(_column(vocabulary, words) >= 0)])
    n = min(NEAR, len(words))
    return bool((sums[n:] - sums[:-n]).max() >= HITS) if n else False


def evaluation_texts(qa: DataFrame) -> list[dict]:
    """The distinct questions and source texts of a block with the rows they stand for and those rows' answers."""
    texts: dict[str, dict] = {}
    for r in qa.select("qa_id", "question", "source_text", "answer").distinct().collect():
        for t in {r["question"], r["source_text"]} - {None}:
            words = word_hashes(t)
            if len(words) >= align.MIN_WORDS:
                got = texts.setdefault(words.tobytes(), {"words": words, "rows": {}})
                got["rows"][r["qa_id"]] = word_hashes(r["answer"]).tolist()
    return sorted(texts.values(), key=lambda t: sorted(t["rows"]))


def _holds(words: list[int], part: list[int]) -> bool:
    n = len(part)
    return bool(n) and any(words[i : i + n] == part for i in range(len(words) - n + 1))


def leaks(documents: DataFrame, qa: DataFrame, cosine: float = COSINE, at_once: int = TEXTS_AT_ONCE) -> DataFrame:
    """(doc_id, qa_id, words, edits, answer): the longest leaked passage of each pair, and whether the answer stands in the document.

    Null and short documents hold nothing; evaluation texts under 16 words cannot
    leak; a null answer is not found. Repeated rows count once. Empty tables give no rows.
    """
    spark = documents.sparkSession
    picked = documents.filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text")
    tokens = cut(spread_few(picked).mapInPandas(_hash_docs, "doc_id bigint, words array<bigint>").filter(F.size("words") >= align.MIN_WORDS * 3 // 4))
    blocks = -(-qa.count() // at_once)
    found = spark.createDataFrame([], LEAK)
    for b in range(blocks):
        texts = evaluation_texts(qa.filter(F.pmod(F.xxhash64("qa_id"), F.lit(blocks)) == b))
        if texts:
            found = found.unionByName(_search(tokens, texts, cosine))
    return found.groupBy("doc_id", "qa_id").agg(F.max(F.struct("words", (-F.col("edits")).alias("e"), "answer")).alias("b")).select(
        "doc_id", "qa_id", F.col("b.words").alias("words"), (-F.col("b.e")).alias("edits"), F.col("b.answer").alias("answer")
    )


LEAK = "doc_id bigint, qa_id int, words int, edits int, answer boolean"


def _search(tokens: DataFrame, texts: list[dict], cosine: float) -> DataFrame:
    """All leaks of one block of evaluation texts, as ``LEAK``."""
    space = fit(tokens, [t["words"] for t in texts])
    owner, rows = [], []
    for k, t in enumerate(texts):
        z = space.latent(t["words"], TEXT_WINDOW, TEXT_STEP, space.basis)
        rows.append(z)
        owner += [k] * len(z)
    shared = tokens.sparkSession.sparkContext.broadcast((space, texts, Centroids(np.concatenate(rows), np.array(owner)), Runs([t["words"] for t in texts])))

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        s, texts, centroids, runs = shared.value
        at = [align.places(t["words"].tolist()) for t in texts]
        own = [np.unique(t["words"]) for t in texts]
        for pdf in batches:
            out = []
            docs = [np.asarray(w, np.int64) for w in pdf["words"]]
            near = [runs.texts(w) for w in docs]
            held, size = [], 0
            for d, words in enumerate(docs):
                for a in range(0, len(words), 20_000):
                    held.append((d, s.latent(words[a : a + 20_000 + DOC_WINDOW], DOC_WINDOW, DOC_STEP, s.basis)))
                    size += len(held[-1][1])
                if size > 8_000 or d == len(docs) - 1:
                    doc = np.repeat([x for x, _ in held], [len(z) for _, z in held])
                    r, k = centroids.search(np.concatenate([z for _, z in held]), cosine)
                    for x, y in zip(doc[r].tolist(), k.tolist()):
                        near[x].add(y)
                    held, size = [], 0
            for doc_id, words, ks in zip(pdf["doc_id"], docs, near):
                ks = [k for k in ks if may_hold(own[k], words)]
                plain = words.tolist() if ks else []
                for k in ks:
                    got = align.longest_passage(at[k], len(texts[k]["words"]), plain)
                    if got:
                        out += [(doc_id, q, got[0], got[1], _holds(plain, a)) for q, a in texts[k]["rows"].items()]
            yield pd.DataFrame(out, columns=["doc_id", "qa_id", "words", "edits", "answer"])

    return tokens.mapInPandas(search, LEAK)
