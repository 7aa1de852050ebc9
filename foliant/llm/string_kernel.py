"""Toxicity by a gap-weighted subsequence kernel, Nystrom landmarks and a linear support vector machine.

The kernel of two words sums over all common subsequences of ORDER letters, each weighted by DECAY to the power of
the letters that it spans in both, and is normalised by the words' own kernels; an insult with gaps or inserted
letters keeps most of its subsequences. Landmarks are words of the labelled sample that tell its classes apart and
that are unlike each other, and then words of clean texts that are like an insult, so that the machine can tell them from its
hidden forms. A word is described by its kernels with all landmarks, multiplied by the inverse root of the landmarks' own
kernel matrix (Nystrom), a sentence by its most insulting word; which word that is follows from the machine, so training
goes back and forth between choosing a word of each toxic document and fitting (squared hinge loss); every word of a clean
document is clean.

A word is an insult if most documents that hold it are toxic and not only a few toxic ones hold it. The machine is
also shown each insult by itself, and in forms that its writers use to hide it: with one and two letters put in, and with a
letter masked. So every insult has weight of its own, and words at the kernels that such forms have lie on its side.

A text has two margins: its most insulting word's, and that of the EVIDENCE-th most insulting one of its different words, since
stems that clean texts hold once or twice are toxic in numbers. Isotonic regression on margins by machines that have not seen the document or form,
weighted to the classes' true shares, makes a probability of each; the larger one is the score.

A word whose kernels are all below LEAST counts as none: a masked or altered insult of two letters more is far above it.

Words are parts between blanks without marks at their ends and without regard to case; a word with marks in it is
read without them too, and the larger kernel holds; runs of three or more single letters are read as one word too; words over
LONG letters are read in overlapping windows. Each distinct word of a worker is worked out once (memo of bounded size).

Fitting uses at most SAMPLE labelled documents of each class, all else covers all rows. Defined results: null and
empty texts have no words and get the score of an all-zero description; equal texts get equal scores, so repeated rows and
ties too; rows with a null id are scored like others and never learnt from; texts are read whole however long; an empty
table gives an empty one; columns of other names pass through, one named like the score is replaced; a sample without both classes
gives score 0 or 1 by the only class, 0 without any.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.byte_words import BLANK, hashes, pieces, spans
from foliant.llm.labelled import remainder, sample, sampled, with_scores
from foliant.llm.scratch import Scratch
from foliant.llm.vocabularies import release_memos
from foliant.llm.whole_vectors import matrix
from foliant.sources.tables import table

ORDER = 4
DECAY = 0.8
#: Most words that tell the classes apart, and most clean words that are like insults.
LANDMARKS, NEAR_MISSES = 20, 10
LONG = 24
FIRST, LAST = "\x01", "\x02"
SAMPLE = 3000
#: Words from which landmarks are chosen, and the log-likelihood ratio between the classes that they need.
CANDIDATES, MERIT = 600, 8.0
#: Largest kernel below which a word is unlike all landmarks, in fitting and in scoring; least kernel of a near miss with an insult.
LEAST, MISS = 0.1, 0.25
MEMO = 700_000
FOLD, HELD_OUT = 3, 1
#: Parts of the sample, each scored by a machine fitted on the others.
FOLDS = 5
#: A document's second margin is that of its different words' of this rank.
EVIDENCE = 3
#: A landmark is an insult if this share of the documents that hold it is toxic, and this share of toxic documents holds it.
INSULT, SPREAD = 0.7, 0.05
#: Forms of each insult of one and of two letters more; their weight in fitting, where all toxic documents have 0.5, and in the
#: steps, where a toxic document has 1.
FORMS, FORM_WEIGHT, STEP_WEIGHT = 8, 0.5, 0.1
THRESHOLD = 0.7

_MARK = np.zeros(256, bool)
_MARK[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
_STOP = np.zeros(256, bool)
_STOP[[10, 33, 46, 63]] = True


def letters(words: list[str], width: int = LONG) -> np.ndarray:
    """Code points of words of at most *width* letters, zero behind their ends."""
    return np.array(words, f"U{width}").view(np.uint32).reshape(len(words), width)


def bounded(word: str) -> str:
    """The word with marks of its two ends, which count as letters."""
    return f"{FIRST}{word}{LAST}"


#: Pairs of letters that are worked out at once, few enough for the processor's cache.
_CELLS = 100_000


def _pair_kernels(s: np.ndarray, t: np.ndarray, order: int, decay: float) -> np.ndarray:
    """The kernel of each row of *s* (B, n) with the same row of *t* (B, m), whose ends match nothing.

    The weight of a common subsequence depends on its first and last match alone: decay ** -(a + j) at the first,
    decay ** (a + j + 2) at the last. Between them matches are chained by sums over all earlier places.
    """
    n, m, size = s.shape[1], t.shape[1], len(s)
    match = np.equal(np.ascontiguousarray(s.T)[:, None], np.ascontiguousarray(t.T)[None])
    place = np.add.outer(np.arange(n, dtype=np.float32), np.arange(m, dtype=np.float32))
    chain = match * (np.float32(decay) ** -place)[:, :, None]
    longer = np.zeros_like(chain)
    for _ in range(1, order):
        for a in range(1, n):
            chain[a] += chain[a - 1]
        for j in range(1, m):
            chain[:, j] += chain[:, j - 1]
        longer[0] = longer[:, 0] = 0
        np.multiply(match[1:, 1:], chain[:-1, :-1], out=longer[1:, 1:])
        chain, longer = longer, chain
    return (np.float32(decay) ** (place + 2)).ravel() @ chain.reshape(n * m, size)


def subsequence_kernel(s: np.ndarray, t: np.ndarray, order: int = ORDER, decay: float = DECAY) -> np.ndarray:
    """The kernel of each row of *s* (B, n) with each row of *t* (L, m), or with *t*'s own row (B, 1, m) if it has three axes."""
    own = t.ndim == 3
    rows = t[:, 0] if own else t
    shape = (len(s), 1 if own else len(t))
    rows = np.where(rows == 0, 0xFFFFFFFF, rows)
    out = np.empty(shape[0] * shape[1], np.float32)
    step = max(1, _CELLS // (s.shape[1] * rows.shape[1]))
    for at in range(0, len(out), step):
        i, j = np.divmod(np.arange(at, min(len(out), at + step)), shape[1])
        out[at : at + step] = _pair_kernels(s[i], rows[i if own else j], order, decay)
    return out.reshape(shape)


def own_kernel(s: np.ndarray) -> np.ndarray:
    return subsequence_kernel(s, s[:, None, :])[:, 0]


class Kernels:
    """Normalised kernels of words with landmarks.

    Only pairs with a common subsequence of ORDER letters are worked out; all others have the kernel 0.
    """

    def __init__(self, landmarks: list[str]):
        size = max(map(len, landmarks)) + 2
        self.t = letters(list(map(bounded, landmarks)), size)
        self.root = np.sqrt(np.maximum(own_kernel(self.t), 1e-12))
        self.code = np.unique(self.t[self.t > 0])
        at = np.searchsorted(self.code, self.t)
        self.places = np.zeros((len(self.code) + 1, len(self.t)), np.uint64)  # a bit for each place of a letter; the last row is of unknown ones
        for j in range(min(64, self.t.shape[1])):
            i = np.flatnonzero(self.t[:, j])
            self.places[at[i, j], i] |= np.uint64(1) << np.uint64(j)
        length = (self.t > 0).sum(axis=1)
        self.long = length > 64
        self.groups = [(int(n), np.flatnonzero(length == n)) for n in np.unique(length)]

    def alike(self, s: np.ndarray) -> np.ndarray:
        """Which landmarks share a subsequence of ORDER letters with each row (bit-parallel longest common subsequence)."""
        at = np.minimum(np.searchsorted(self.code, s), len(self.code) - 1)
        at = np.where(self.code[at] == s, at, len(self.code))
        free = np.full((len(s), len(self.t)), np.iinfo(np.uint64).max)
        for letter in at.T:
            met = free & self.places[letter]
            free = (free + met) | (free - met)
        return (np.bitwise_count(~free) >= ORDER) | self.long

    def rows(self, words: list[str]) -> np.ndarray:
        """One row of kernels for each word, however long it is; a word with marks in it is read without them too."""
        parts, owner = [], []
        for i, word in enumerate(words):
            for w in map(bounded, (word,) if word.isalnum() else (word, "".join(filter(str.isalnum, word)))):
                for at in range(0, max(1, len(w) - LONG // 2), LONG // 2):
                    parts.append(w[at : at + LONG])
                    owner.append(i)
        size = np.fromiter(map(len, parts), np.int64, len(parts))
        out = np.zeros((len(words), len(self.root)), np.float32)
        order, owner = np.argsort(size, kind="stable"), np.array(owner, np.int64)
        codes = letters(parts) if parts else np.zeros((0, LONG), np.uint32)
        for at in range(0, len(order), 8192):
            pick = order[at : at + 8192]
            s = codes[pick, : max(1, size[pick].max())]
            near = self.alike(s)
            some = np.flatnonzero(near.any(axis=1))
            if not len(some):
                continue
            root = np.zeros(len(s), np.float32)
            root[some] = np.sqrt(np.maximum(own_kernel(s[some]), 1e-12))
            for n, group in self.groups:
                i, j = np.nonzero(near[:, group])
                j = group[j]
                for part in range(0, len(i), 8192):
                    x, y = i[part : part + 8192], j[part : part + 8192]
                    k = subsequence_kernel(s[x], self.t[y, None, :n])[:, 0] / (root[x] * self.root[y])
                    np.maximum.at(out, (owner[pick[x]], y), k)
        return out


def _word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts, ends = spans(~BLANK[data], offsets)
    for _ in range(8):
        late = (ends - starts > 1) & _MARK[data[np.maximum(ends - 1, 0)]] if len(starts) else np.zeros(0, bool)
        early = (ends - starts > 1) & _MARK[data[np.minimum(starts, len(data) - 1)]] if len(starts) else late
        if not (late.any() or early.any()):
            break
        ends = ends - (late & ~early | late & (ends - starts > 2))
        starts = starts + early
    return starts, ends


def _spelled(raw: bytes, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, row: np.ndarray) -> list[tuple[int, str]]:
    """Row and joined letters of each run of three or more single letters."""
    lead = (data[starts] & 0xC0) != 0x80
    count = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    one = lead & (count[ends] - count[starts] == 1)
    link = one[1:] & one[:-1] & (row[1:] == row[:-1])
    out, edges = [], np.flatnonzero(np.diff(np.concatenate(([0], link.astype(np.int8), [0]))))
    for i in range(0, len(edges), 2):
        a, b = edges[i], edges[i + 1]
        if b - a >= 2:
            out.append((int(row[a]), "".join([raw[x:y].decode("utf-8", "replace") for x, y in zip(starts[a : b + 1].tolist(), ends[a : b + 1].tolist(), strict=True)])))
    return out


def sentences(text: bytes) -> list[list[str]]:
    """The words of each sentence of a text."""
    data = np.frombuffer(text, np.uint8)
    if not len(data):
        return []
    starts, ends = _word_spans(data, np.array([0, len(data)]))
    if not len(starts):
        return []
    number = np.concatenate(([0], np.cumsum(_STOP[data])))[starts].tolist()
    out: dict[int, list[str]] = {}
    for a, b, n in zip(starts.tolist(), ends.tolist(), number, strict=True):
        out.setdefault(n, []).append(text[a:b].decode("utf-8", "replace").lower())
    for _, joined in _spelled(text, data, starts, ends, np.zeros(len(starts), np.int64)):
        out.setdefault(-1 - len(out), []).append(joined.lower())
    return list(out.values())


def squared_hinge(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """A linear support vector machine with squared hinge loss by Newton steps; the last coefficient is the bias."""
    x = np.column_stack((x, np.ones(len(x))))
    sign, w = np.where(y > 0, 1.0, -1.0), np.zeros(x.shape[1])
    eye = np.eye(x.shape[1]) * ridge * weight.sum()
    eye[-1, -1] *= 1e-4
    for _ in range(30):
        active = sign * (x @ w) < 1
        xa = x[active] * weight[active, None]
        new = np.linalg.solve(x[active].T @ xa + eye, xa.T @ sign[active])
        if np.allclose(new, w, atol=1e-9):
            break
        w = new
    return w


def steps(margin: np.ndarray, y: np.ndarray, weight: np.ndarray, share: float) -> tuple[np.ndarray, np.ndarray]:
    """Margins and rising shares of label 1 at them, to be joined by straight lines: isotonic regression.

    Neighbours in the order of margins are pooled as long as a share would fall; each pool counts one more document,
    of the classes' true *share*, so that few documents don't give certainty.
    """
    pools: list[list[float]] = []  # least margin, largest margin, weight, weight of label 1
    order = np.argsort(margin, kind="stable")
    of = lambda x: (x[3] + share) / (x[2] + 1)
    for m, label, w in zip(margin[order].tolist(), y[order].tolist(), weight[order].tolist(), strict=True):
        if pools and pools[-1][1] == m:
            pools[-1][2] += w
            pools[-1][3] += w * label
        else:
            pools.append([m, m, w, w * label])
        while len(pools) > 1 and of(pools[-2]) >= of(pools[-1]):
            _, high, w, one = pools.pop()
            pools[-1] = [pools[-1][0], high, pools[-1][2] + w, pools[-1][3] + one]
    return np.array([x for p in pools for x in p[:2]]), np.array([of(p) for p in pools for _ in range(2)])


def pick_landmarks(words: list[str], most: int = LANDMARKS) -> list[str]:
    """From words in order of merit, those unlike the ones picked before; then the next best, up to *most*."""
    words = [w for w in words if len(w) >= ORDER]
    if not words:
        return []
    codes = letters(list(map(bounded, words)), max(map(len, words)) + 2)
    root = np.sqrt(np.maximum(own_kernel(codes), 1e-12))
    like = subsequence_kernel(codes, codes) / (root[:, None] * root[None])
    for limit in (0.3, 0.6, 0.9):
        picked: list[int] = []
        for i in range(len(words)):
            if len(picked) < most and all(like[i, j] < limit for j in picked):
                picked.append(i)
        if len(picked) >= most:
            break
    return [words[i] for i in picked]


def hidden(word: str, n: int = FORMS) -> list[str]:
    """Forms of a word as its writers hide it: *n* each with one and with two letters put in, and all with a letter masked."""
    g = np.random.default_rng(list(word.encode()))
    out = [f"{word[:i]}*{word[i + 1 :]}" for i in range(1, len(word) - 1)]
    for more in (1, 2):
        for _ in range(n):
            form = word
            for _ in range(more):
                at = int(g.integers(1, len(form)))
                form = form[:at] + chr(97 + int(g.integers(26))) + form[at:]
            out.append(form)
    return out


class Model:
    """What scoring needs, all of bounded size: landmarks, coefficients, and shares of label 1 by margin, for a text's first
    and EVIDENCE-th margin."""

    def __init__(self, landmarks: list[str], weights: np.ndarray, shares: list[tuple[np.ndarray, np.ndarray]]):
        self.landmarks, self.weights, self.shares = landmarks, weights, shares

    @classmethod
    def constant(cls, p: float) -> Model:
        return cls([], np.zeros(1), [(np.zeros(1), np.full(1, p))])

    def margins(self, kernels: np.ndarray) -> np.ndarray:
        """Margins of words; one that is unlike all landmarks has that of no word."""
        return (kernels * (kernels.max(axis=1, initial=0) >= LEAST)[:, None]) @ self.weights[:-1] + self.weights[-1]

    def probability(self, margins: np.ndarray) -> np.ndarray:
        """The larger of the shares at each text's margins; a thousandth of it is a sigmoid, so that larger margins always score higher."""
        if not self.landmarks:
            return np.full(len(margins), self.shares[0][1][0])
        best = np.max([np.interp(margins[:, i], xs, ps) for i, (xs, ps) in enumerate(self.shares)], axis=0)
        return 0.999 * best + 0.001 / (1 + np.exp(-np.clip(margins[:, 0], -40, 40)))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", most: int = SAMPLE) -> Model:
    """A model from labelled documents whose ids are not held out."""
    usable = F.coalesce(remainder(F.col("doc_id"), FOLD) != HELD_OUT, F.lit(False))
    share = labels.filter(usable & F.col("doc_id").isNotNull()).agg(F.avg(F.col(label).cast("double"))).first()[0]
    chosen = sample(labels, label, usable, most)
    rows = sampled(docs, chosen)

    def words_of(batches):
        release_memos()
        for batch in batches:
            ids, ys, ws = [], [], []
            for doc, y, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                found = {w for s in sentences(text.as_py()) for w in s}
                ids += [doc] * len(found)
                ys += [y] * len(found)
                ws += found
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ys, pa.int32()), pa.array(ws, pa.string())], names=["id", "y", "w"])

    sizes = {r["_y"]: r["n"] for r in chosen.groupBy("_y").agg(F.count("*").alias("n")).collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    if not n1 or not n0:
        return Model.constant(float(n1 > 0))
    scratch = Scratch(docs.sparkSession)
    held = scratch.save(rows.select(F.col("_id").cast("long"), "_y", "_text").mapInArrow(words_of, "id long, y int, w string"))
    seen = held.filter(F.length("w").between(ORDER, LONG)).groupBy("w").agg(F.sum("y").alias("a"), F.sum(1 - F.col("y")).alias("b"))
    part = lambda k, n: F.when(k > 0, k * F.log(k / (n * (F.col("a") + F.col("b")) / (n1 + n0)))).otherwise(0.0)
    merit = part(F.col("a"), n1) + part(F.col("b"), n0)
    best = seen.filter((F.col("a") * n0 > F.col("b") * n1) & (merit >= MERIT)).orderBy(F.desc(F.round(merit, 6)), "w").limit(CANDIDATES).select("w", "a", "b").collect()
    telling = pick_landmarks([r["w"] for r in best])
    if not telling:
        return Model.constant(share)
    rate = {r["w"]: r["a"] * share / n1 / (r["a"] * share / n1 + (r["b"] + 0.5) * (1 - share) / n0) for r in best if r["a"] >= max(3, SPREAD * n1)}
    bad = [w for w in telling if rate.get(w, 0.0) >= INSULT]

    def kernels_with(landmarks: list[str], least: float):
        def run(batches):
            release_memos()
            kernels = Kernels(landmarks)
            for batch in batches:
                k = kernels.rows(batch.column(0).to_pylist())
                keep = pa.array(k.max(axis=1, initial=0) >= least)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(k), pa.list_(pa.float32())), batch.column(1)], names=["w", "v", "b"]).filter(keep)

        return run

    schema = "w string, v array<float>"
    misses: list[str] = []
    if bad:
        close = scratch.save(held.filter("y = 0").groupBy("w").agg(F.count("*").alias("b")).mapInArrow(kernels_with(bad, MISS), f"{schema}, b long"))
        like = close.filter(~F.col("w").isin(telling)).orderBy(F.desc(F.array_max("v") * F.log1p("b")), "w").limit(CANDIDATES)
        misses = pick_landmarks([r["w"] for r in like.select("w").collect()], NEAR_MISSES)
    words = scratch.save(held.groupBy("w").agg(F.count("*").alias("b")).mapInArrow(kernels_with(telling + misses, LEAST), f"{schema}, b long"))
    got = words.select("w", "v").toArrow()  # words of the bounded sample
    names, k = got.column("w").to_pylist(), matrix(got.column("v")).reshape(-1, len(telling) + len(misses))
    told = held.join(words.select("w"), "w").select("id", "w").toArrow()
    place = {w: i for i, w in enumerate(names)}
    sampled_ids = sorted((r["_id"], r["_y"]) for r in chosen.collect())
    out = train(telling + misses, bad, np.array(sampled_ids, np.int64), k.astype(np.float64), told.column("id").to_numpy(), np.array([place[w] for w in told.column("w").to_pylist()], np.int64), float(share))
    scratch.drop(held, words)
    return out


def ranked(margin: np.ndarray, doc: np.ndarray, n: int, low: float, ranks: int = EVIDENCE) -> np.ndarray:
    """The first *ranks* margins of each of *n* documents, *low* where it has fewer."""
    out = np.full((n, ranks), low)
    order = np.lexsort((-margin, doc))
    at = np.arange(len(order)) - np.searchsorted(doc[order], doc[order])
    some = at < ranks
    out[doc[order][some], at[some]] = margin[order][some]
    return out


def train(landmarks: list[str], bad: list[str], known: np.ndarray, k: np.ndarray, ids: np.ndarray, word: np.ndarray, share: float) -> Model:
    """Machine and steps from a sample: ids and labels (*known*), kernels of words, and which document holds which word."""
    order = np.lexsort((*k.T[::-1],))
    rank = np.empty(len(k), np.int64)
    rank[order] = np.arange(len(k))
    k, word = k[order], rank[word]  # an order that doesn't depend on partitions
    docs, of = known[:, 0], known[:, 1].astype(float)
    order = np.lexsort((word, ids))
    doc, word = np.searchsorted(docs, ids[order]), word[order]
    kernels = Kernels(landmarks)
    t = kernels.rows(landmarks).astype(np.float64)
    value, vector = np.linalg.eigh((t + t.T) / 2 + 1e-3 * np.eye(len(t)))
    half = vector @ np.diag(1 / np.sqrt(np.maximum(value, 1e-6))) @ vector.T
    x, start = k @ half, k[:, : len(landmarks)].max(axis=1, initial=0)
    shown = [form for w in bad for form in (w, *hidden(w))]
    forms = kernels.rows(shown).astype(np.float64) @ half if shown else np.zeros((0, len(landmarks)))
    fold, form_fold = np.arange(len(docs)) % FOLDS, np.arange(len(forms)) % FOLDS
    toxic = of[doc] > 0

    def machine(seen: np.ndarray, forms: np.ndarray) -> np.ndarray:
        """Coefficients from the documents *seen* and *forms*: words are chosen by the margins so far, then the machine is fitted.

        A clean word weighs as many clean documents as hold it.
        """
        mine = seen[doc]
        clean = np.bincount(word[mine & ~toxic], minlength=len(x)).astype(float)  # in how many clean documents a word is
        at = np.flatnonzero(clean)
        margin = start
        for _ in range(5):
            rows = np.flatnonzero(mine & toxic)
            top = rows[np.lexsort((-margin[word[rows]], doc[rows]))]
            top = word[top[np.unique(doc[top], return_index=True)[1]]]
            n1, n0 = max(1, len(top)), max(1.0, (seen & (of == 0)).sum())
            data = np.concatenate((x[top], forms, x[at], np.zeros((1, x.shape[1]))))
            weight = np.concatenate((np.full(len(top), 0.5 / n1), np.full(len(forms), FORM_WEIGHT / max(1, len(forms))), 0.5 * clean[at] / n0, np.full(1, 1e-3)))
            w = squared_hinge(data, np.concatenate((np.ones(len(top) + len(forms)), np.zeros(len(at) + 1))), weight, 1e-4)
            margin = x @ w[:-1] + w[-1]
        return w

    def margins(w: np.ndarray, some: np.ndarray) -> np.ndarray:
        """The ranked margins of the documents *some*; a word below the bias is no better than none."""
        mine = np.isin(doc, some)
        return np.maximum(ranked(x[word[mine]] @ w[:-1] + w[-1], np.searchsorted(some, doc[mine]), len(some), w[-1]), w[-1])

    # The steps are fitted to margins of documents and forms that their machine has not seen; a clean document has the larger
    # one of such a margin and of that by the last machine, whose scale may differ a little.
    w = machine(np.ones(len(docs), bool), forms)
    high, form_high = margins(w, np.arange(len(docs))), np.zeros(len(forms))
    for part in range(FOLDS):
        other = machine(fold != part, forms[form_fold != part])
        own = np.flatnonzero(fold == part)
        unseen = margins(other, own)
        high[own] = np.where(of[own, None] > 0, unseen, np.maximum(high[own], unseen))
        form_high[form_fold == part] = forms[form_fold == part] @ other[:-1] + other[-1]
    n1, n0 = max(1, of.sum()), max(1, (1 - of).sum())
    weight = np.where(of > 0, share / n1, (1 - share) / n0) * len(docs)
    more = np.full(len(forms), STEP_WEIGHT * share * len(docs) / n1)
    first = steps(np.concatenate((high[:, 0], form_high)), np.concatenate((of, np.ones(len(forms)))), np.concatenate((weight, more)), share)
    return Model(landmarks, np.append(half @ w[:-1], w[-1]), [first, steps(high[:, -1], of, weight, share)])


class Scorer:
    """Scores of columns of texts, with a memo of the margins of words by their hash."""

    def __init__(self, model: Model):
        self.model, self.kernels, self.memo = model, Kernels(model.landmarks) if model.landmarks else None, {}

    def __call__(self, column: pa.Array) -> pa.Array:
        low = self.model.weights[-1]
        high = np.full((len(column), EVIDENCE), low)
        if self.kernels is not None:
            for at, end, data, offsets in pieces(column):
                high[at:end] = np.maximum(ranked(*self._margins(data, offsets), end - at, low), low)  # a word below the bias is no better than none
        return pa.array(self.model.probability(high[:, [0, EVIDENCE - 1]]), pa.float64())

    def _margins(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Margins of the different words of each of a run of texts, those above no word's, and their text."""
        starts, ends = _word_spans(data, offsets)
        if not len(starts):
            return np.zeros(0), np.zeros(0, np.int64)
        row = whole = np.searchsorted(offsets, starts, side="right") - 1
        distinct, first, inverse = np.unique(hashes(data, starts, ends), return_index=True, return_inverse=True)
        keys, memo, raw = distinct.tolist(), self.memo, data.tobytes()
        if len(memo) + len(keys) > MEMO:
            memo.clear()
        new = [i for i, key in enumerate(keys) if key not in memo]
        at = first[new]
        words = [raw[a:b].decode("utf-8", "replace").lower() for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)]
        memo.update(zip([keys[i] for i in new], self.model.margins(self.kernels.rows(words)).tolist(), strict=True))
        value = np.fromiter(map(memo.__getitem__, keys), np.float64, len(keys))
        some = np.flatnonzero((value > self.model.weights[-1])[inverse])
        row, word = np.divmod(np.unique(row[some] * len(keys) + inverse[some]), max(1, len(keys)))
        margin = value[word]
        spelled = sorted(set(_spelled(raw, data, starts, ends, whole)))
        if spelled:
            more = self.model.margins(self.kernels.rows([w.lower() for _, w in spelled]))
            margin, row = np.concatenate((margin, more)), np.concatenate((row, [r for r, _ in spelled]))
        return margin, row


def toxicity(docs: DataFrame, labels: DataFrame, known: DataFrame | None = None, out: str = "score") -> DataFrame:
    """*docs* with *out* (probability that label ``toxic`` is 1); the model is fitted on *known*, or on *docs* themselves."""
    model = fit(docs if known is None else known, labels)

    def scorer():
        from foliant.llm.string_kernel import Scorer

        release_memos()
        return Scorer(model)

    return with_scores(docs, scorer, out=out)


def op6_string_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity(docs, table(spark, sf_dir, "labels"))
    held = F.coalesce(remainder(F.col("doc_id"), FOLD) == HELD_OUT, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


QUERIES = {"op6_string_kernel": op6_string_kernel}
