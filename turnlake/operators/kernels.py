"""Numpy kernels of one recording: linkage, PLDA, mixture inference, assignment."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations, product

import numpy as np

from turnlake.config import INACTIVE, PLDA_DIM, VbxConfig
from turnlake.functions.vectors import np_logsumexp, np_normalize_rows


def pairwise_distance(x: np.ndarray) -> np.ndarray:
    """Square matrix of Euclidean distances."""
    out = np.zeros((len(x), len(x)), x.dtype)
    for i, row in enumerate(x):
        out[i, i + 1 :] = out[i + 1 :, i] = np.sqrt(((x[i + 1 :] - row) ** 2).sum(axis=1))
    return out


def centroid_linkage(distance: np.ndarray) -> list[tuple[int, int, float]]:
    """Merges (lower id, higher id, height) by the Lance-Williams rule of centroids on squared distances.

    Ids 0 to n - 1 are rows, n + k is the k-th merge.  Of equal distances the pair with
    the lowest rows merges first.  Every row keeps its nearest row behind it, which only
    rows next to a merge must look for again, so time is mostly quadratic.
    """
    d = np.asarray(distance, "float64") ** 2
    n = len(d)
    np.fill_diagonal(d, np.inf)
    ids, sizes, steps = list(range(n)), np.ones(n), []
    near, least = np.zeros(n, "int64"), np.full(n, np.inf)

    def look(i: int) -> None:
        if i + 1 < n:
            near[i] = i + 1 + int(d[i, i + 1 :].argmin())
            least[i] = d[i, near[i]]

    for i in range(n):
        look(i)
    for step in range(n - 1):
        a = int(least.argmin())
        b = int(near[a])
        height = d[a, b]
        steps.append((min(ids[a], ids[b]), max(ids[a], ids[b]), float(np.sqrt(max(height, 0.0)))))
        size = sizes[a] + sizes[b]
        with np.errstate(invalid="ignore"):
            row = (sizes[a] * d[a] + sizes[b] * d[b]) / size - sizes[a] * sizes[b] * height / size**2
        row[~np.isfinite(d[a]) | ~np.isfinite(d[b])] = np.inf
        d[a], d[:, a] = row, row
        d[a, a] = np.inf
        d[b], d[:, b] = np.inf, np.inf
        ids[a], sizes[a] = n + step, size
        least[b] = np.inf
        before = d[:a, a]
        closer = (before < least[:a]) | ((before == least[:a]) & (a < near[:a]))
        lost = np.flatnonzero((near[:b] == a) | (near[:b] == b))
        near[:a][closer], least[:a][closer] = a, before[closer]
        for i in lost.tolist():
            if i >= a or not closer[i]:
                look(i)
        look(a)
    return steps


#: Rows whose distances to all others are computed at once.
LINKAGE_BLOCK = 256
#: Squared distances of unit rows below this are rounding, and 0.
LINKAGE_ZERO = 1e-12


def linkage_of_rows(x: np.ndarray) -> list[tuple[int, int, float]]:
    """The merges of ``centroid_linkage`` from rows themselves, in memory linear in their number.

    A merged cluster is its centroid and its size, so the distances that the rule needs
    are those of centroids, computed when they are asked for.
    """
    c = np.array(x, "float64")
    n = len(c)
    ids, sizes, alive, norms = np.arange(n), np.ones(n), np.ones(n, bool), (c * c).sum(axis=1)
    near, least, steps = np.zeros(n, "int64"), np.full(n, np.inf), []

    def squared(rows: np.ndarray, start: int) -> np.ndarray:
        d = norms[rows][:, None] - 2 * (c[rows] @ c[start:].T) + norms[start:]
        d[d < LINKAGE_ZERO] = 0
        d[:, ~alive[start:]] = np.inf
        return d

    def look(rows: np.ndarray) -> None:
        """Nearest rows behind each of the sorted ``rows``."""
        for lo in range(0, len(rows), LINKAGE_BLOCK):
            part = rows[lo : lo + LINKAGE_BLOCK]
            start = int(part[0])
            d = squared(part, start)
            d[np.arange(start, n) <= part[:, None]] = np.inf
            at = d.argmin(axis=1)
            near[part], least[part] = start + at, d[np.arange(len(part)), at]

    look(np.arange(n))
    for step in range(n - 1):
        a = int(least.argmin())
        b, height, size = int(near[a]), float(least[a]), sizes[a] + sizes[near[a]]
        steps.append((int(min(ids[a], ids[b])), int(max(ids[a], ids[b])), height**0.5))
        c[a] = (sizes[a] * c[a] + sizes[b] * c[b]) / size
        ids[a], sizes[a], norms[a], alive[b], least[b] = n + step, size, c[a] @ c[a], False, np.inf
        before = squared(np.array([a]), 0)[0, :a]
        closer = (before < least[:a]) | ((before == least[:a]) & np.isfinite(before) & (a < near[:a]))
        lost = np.flatnonzero(alive[:b] & ((near[:b] == a) | (near[:b] == b)))
        near[:a][closer], least[:a][closer] = a, before[closer]
        again = lost[(lost >= a) | ~np.r_[closer, np.zeros(n - a, bool)][lost]]
        look(np.union1d(again, [a]))
    return steps


def flat_labels(n: int, steps: list[tuple[int, int, float]], threshold: float) -> np.ndarray:
    """Labels in depth-first order, left child first; a subtree whose own height is within ``threshold``, in single precision, has one label."""
    labels, label = np.full(n, -1, "int64"), 0
    stack: list[tuple[int, bool]] = [(n + len(steps) - 1, False)] if n else []
    while stack:
        node, inside = stack.pop()
        if node < 0:  # the end of a subtree with one label
            label += 1
        elif node < n:
            labels[node] = label
            label += not inside
        else:
            left, right, height = steps[node - n]
            whole = inside or np.float32(height) <= np.float32(threshold)
            if whole and not inside:
                stack.append((-1, True))
            stack += [(right, whole), (left, whole)]
    return labels


def cluster_rows(x: np.ndarray, threshold: float = 0.6) -> np.ndarray:
    """Agglomerative labels of embedding rows, scaled to unit length in double precision: single precision makes other pairs the nearest."""
    if len(x) < 2:
        return np.zeros(len(x), "int64")
    unit = np_normalize_rows(np.asarray(x, "float32").astype("float64"))
    return flat_labels(len(x), linkage_of_rows(unit), threshold)


class PldaError(ValueError):
    pass


@dataclass
class Plda:
    mean1: np.ndarray
    mean2: np.ndarray
    lda: np.ndarray
    mu: np.ndarray
    transform: np.ndarray
    phi: np.ndarray

    @classmethod
    def derive(cls, mean1, mean2, lda, mu, tr, psi) -> Plda:
        """From stored parameters: generalized eigenvectors of the between-class against the within-class covariance, largest first."""
        mean1, mean2, lda, mu, tr, psi = (np.asarray(x, "float64") for x in (mean1, mean2, lda, mu, tr, psi))
        if (psi == 0).any():
            raise PldaError("psi has a zero")
        within, between = np.linalg.inv(tr.T @ tr), np.linalg.inv((tr.T / psi) @ tr)
        low = np.linalg.inv(np.linalg.cholesky(within))
        values, vectors = np.linalg.eigh(low @ between @ low.T)
        vectors = low.T @ vectors
        keep = np.argsort(-values, kind="stable")[: lda.shape[1]]
        return cls(mean1, mean2, lda, mu, vectors.T[keep], values[keep])

    @classmethod
    def load(cls, folder: str) -> Plda:
        """From plda_{mean1,mean2,lda,mu,tr,psi}.npy; single floats are widened."""
        return cls.derive(*(np.load(f"{folder}/plda_{x}.npy").astype("float64") for x in ("mean1", "mean2", "lda", "mu", "tr", "psi")))

    @classmethod
    def synthetic(cls, dim: int, out: int, seed: int = 0) -> Plda:
        """Random parameters of the right shapes, for tests and stand-ins."""
        rng = np.random.default_rng(seed)
        tr = np.eye(out) + 0.1 * rng.standard_normal((out, out))
        return cls.derive(0.01 * rng.standard_normal(dim), 0.01 * rng.standard_normal(out), rng.standard_normal((dim, out)) / np.sqrt(dim), np.zeros(out), tr, rng.uniform(0.5, 4, out))

    def xvectors(self, x: np.ndarray) -> np.ndarray:
        x = np_normalize_rows(np.asarray(x, "float64") - self.mean1) * np.sqrt(self.lda.shape[0])
        return np_normalize_rows(x @ self.lda - self.mean2) * np.sqrt(self.lda.shape[1])

    def features(self, x: np.ndarray, dim: int = PLDA_DIM) -> np.ndarray:
        return ((self.xvectors(x) - self.mu) @ self.transform[: min(dim, len(self.transform))].T).astype("float32")


def initial_responsibilities(labels: np.ndarray, smoothing: float = 7.0) -> np.ndarray:
    """Softened one-hot rows in single precision; plain one-hot for a negative ``smoothing``."""
    labels = np.asarray(labels, "int64")
    hot = np.zeros((len(labels), int(labels.max(initial=0)) + 1), "float32")
    hot[np.arange(len(labels)), labels] = 1
    if smoothing < 0:
        return hot
    e = np.exp(smoothing * (hot.astype("float64") - 1))
    return (e / e.sum(axis=1, keepdims=True)).astype("float32")


def expectation(x: np.ndarray, phi: np.ndarray, weight: np.ndarray, moment: np.ndarray, prior: np.ndarray, c: VbxConfig) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scaled rows, responsibilities and log evidence of rows under speakers with these weights, moments and priors."""
    ratio, rho = c.fa / c.fb, x * np.sqrt(phi)
    constant = -0.5 * ((x * x).sum(axis=1) + x.shape[1] * np.log(2 * np.pi))
    inverse = 1 / (1 + ratio * weight[:, None] * phi)
    alpha = ratio * inverse * moment
    joint = c.fa * (rho @ alpha.T - 0.5 * ((inverse + alpha**2) @ phi) + constant[:, None]) + np.log(prior + 1e-8)
    evidence = np_logsumexp(joint)
    return rho, np.exp(joint - evidence[:, None]), evidence


def vbx(features: np.ndarray, phi: np.ndarray, start: np.ndarray, config: VbxConfig | None = None, trace: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Responsibilities and speaker priors of a variational mixture, in double precision inside.

    ``trace`` gathers the bound of each iteration; the last update before the stop counts.
    """
    c = config or VbxConfig()
    x, phi = np.asarray(features, "float32").astype("float64"), np.asarray(phi, "float32").astype("float64")
    gamma = np.asarray(start, "float32").astype("float64")
    prior = np.full(gamma.shape[1], 1 / gamma.shape[1])
    rho, ratio, before = x * np.sqrt(phi), c.fa / c.fb, -np.inf
    for turn in range(c.max_iters):
        weight, moment = gamma.sum(axis=0), gamma.T @ rho
        _, gamma, evidence = expectation(x, phi, weight, moment, prior, c)
        inverse = 1 / (1 + ratio * weight[:, None] * phi)
        alpha = ratio * inverse * moment
        prior = gamma.sum(axis=0) / gamma.sum()
        bound = evidence.sum() + c.fb * 0.5 * (np.log(inverse) - inverse - alpha**2 + 1).sum()
        if trace is not None:
            trace.append(bound)
        if turn > 0 and bound - before < c.epsilon:
            break
        before = bound
    return gamma.astype("float32"), prior.astype("float32")


def vbx_many(features: np.ndarray, phi: np.ndarray, start: np.ndarray, config: VbxConfig | None = None) -> tuple[np.ndarray, np.ndarray]:
    """``vbx`` of recordings with as many rows and speakers each: (recordings, rows, ...); each stops where it would alone."""
    c = config or VbxConfig()
    x, phi = np.asarray(features, "float32").astype("float64"), np.asarray(phi, "float32").astype("float64")
    gamma = np.asarray(start, "float32").astype("float64")
    prior = np.full((len(gamma), gamma.shape[2]), 1 / gamma.shape[2])
    rho, ratio, before = x * np.sqrt(phi), c.fa / c.fb, np.full(len(x), -np.inf)
    constant = -0.5 * ((x * x).sum(axis=2) + x.shape[2] * np.log(2 * np.pi))
    at = np.arange(len(x))  # those that go on
    for turn in range(c.max_iters):
        g, r = gamma[at], rho[at]
        inverse = 1 / (1 + ratio * g.sum(axis=1)[:, :, None] * phi)
        alpha = ratio * inverse * (g.transpose(0, 2, 1) @ r)
        joint = c.fa * (r @ alpha.transpose(0, 2, 1) - 0.5 * ((inverse + alpha**2) @ phi)[:, None] + constant[at][:, :, None]) + np.log(prior[at] + 1e-8)[:, None]
        evidence = np_logsumexp(joint.reshape(-1, joint.shape[2])).reshape(joint.shape[:2])
        gamma[at] = g = np.exp(joint - evidence[:, :, None])
        prior[at] = g.sum(axis=1) / g.sum(axis=(1, 2))[:, None]
        bound = evidence.sum(axis=1) + c.fb * 0.5 * (np.log(inverse) - inverse - alpha**2 + 1).sum(axis=(1, 2))
        on = np.full(len(at), True) if turn == 0 else ~(bound - before[at] < c.epsilon)
        before[at] = bound
        at = at[on]
        if not len(at):
            break
    return gamma.astype("float32"), prior.astype("float32")


def kept_speakers(prior: np.ndarray, threshold: float = 1e-7) -> np.ndarray:
    """Speakers with a prior above ``threshold``; without any the likeliest, the last of equals."""
    kept = np.flatnonzero(prior > np.float32(threshold))
    return kept if len(kept) or not len(prior) else np.array([len(prior) - 1 - int(np.argmax(prior[::-1]))])


def weighted_centroids(x: np.ndarray, gamma: np.ndarray, kept: np.ndarray) -> np.ndarray:
    w = gamma[:, kept]
    return ((w / np.maximum(w.sum(axis=0), 1e-8)).T @ x).astype("float32")


def assign_chunk(scores: np.ndarray, active: list[int]) -> dict[int, int]:
    """Best one-to-one choice of clusters for the active local speakers.

    Of equal choices the first in order of the speakers' clusters wins, where a speaker
    that is left out comes before any cluster.  A speaker only needs as many of its best
    clusters as speakers are placed: the others can't take them all.
    """
    clusters = scores.shape[1]
    size = min(len(active), clusters)
    best, found = (-np.inf, ()), {}
    tops = {s: np.argsort(-scores[s], kind="stable")[:size].tolist() for s in active}
    for chosen in combinations(active, size):
        for picks in product(*[tops[s] for s in chosen]):
            if len(set(picks)) < size:
                continue
            total, pairs = np.float32(0), dict(zip(chosen, picks))
            for s, c in pairs.items():
                total = np.float32(total + scores[s, c])
            rank = tuple(pairs.get(s, -1) for s in active)
            if total > best[0] or total == best[0] > -np.inf and rank < best[1]:
                best, found = (total, rank), pairs
    return found


def chunk_scores(embeddings: np.ndarray, active: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """1 + cosine of active, finite speakers; all others one below the least of these."""
    scores = np.full((len(embeddings), len(centroids)), -np.inf, "float32")
    ok = active & np.isfinite(embeddings).all(axis=1)
    scores[ok] = 1 + np_normalize_rows(embeddings[ok].astype("float32")) @ np_normalize_rows(centroids.astype("float32")).T
    finite = np.isfinite(scores)
    if finite.any():
        scores[~finite] = scores[finite].min() - 1
    return scores


def cluster_recording(training: np.ndarray, embeddings: np.ndarray, active: np.ndarray, plda: Plda, threshold: float, config: VbxConfig, keep: float) -> np.ndarray:
    """Cluster of every (chunk, local speaker): one recording's embeddings (chunks, speakers, dim) and activity flags."""
    if len(training) < 2:
        return _labels(training, embeddings, active, None, None, keep)
    start = initial_responsibilities(cluster_rows(training, threshold), config.init_smoothing)
    return _labels(training, embeddings, active, *vbx(plda.features(training), plda.phi[:PLDA_DIM], start, config), keep)


def _labels(training: np.ndarray, embeddings: np.ndarray, active: np.ndarray, gamma: np.ndarray | None, prior: np.ndarray | None, keep: float) -> np.ndarray:
    labels = np.full(active.shape, INACTIVE, "int64")
    if gamma is None:
        labels[active] = 0
        return labels
    centroids = weighted_centroids(training.astype("float32"), gamma, kept_speakers(prior, keep))
    for chunk in range(len(active)):
        speakers = np.flatnonzero(active[chunk]).tolist()
        for s, c in assign_chunk(chunk_scores(embeddings[chunk], active[chunk], centroids), speakers).items():
            labels[chunk, s] = c
    return labels


def cluster_many(recordings: list[tuple[np.ndarray, np.ndarray, np.ndarray]], plda: Plda, threshold: float, config: VbxConfig, keep: float) -> list[np.ndarray]:
    """``cluster_recording`` of (training, embeddings, active); mixtures of one shape run together."""
    by_shape: dict[tuple, list] = {}
    mixtures: list[tuple] = [(None, None)] * len(recordings)
    for i, (training, _, _) in enumerate(recordings):
        if len(training) >= 2:
            start = initial_responsibilities(cluster_rows(training, threshold), config.init_smoothing)
            by_shape.setdefault(start.shape, []).append((i, plda.features(training), start))
    for found in by_shape.values():
        places, features, starts = zip(*found)
        for i, *mixture in zip(places, *vbx_many(np.stack(features), plda.phi[:PLDA_DIM], np.stack(starts), config)):
            mixtures[i] = tuple(mixture)
    return [_labels(*recording, *mixture, keep) for recording, mixture in zip(recordings, mixtures)]


def least_dominating(x: np.ndarray, y: np.ndarray, value: np.ndarray, qx: np.ndarray, qy: np.ndarray) -> np.ndarray:
    """For each query the least ``value`` (whole numbers from 0) of the points with x <= qx and y >= qy, and the number of points if there is none.

    The points up to qx are blocks of lengths 1, 2, 4, ..., one for each bit of their
    number; a block is sorted by y with the least value from each place on.
    """
    n, order = len(x), np.argsort(x, kind="stable")
    y, value, upto = y[order], value[order], np.searchsorted(x[order], qx, "right")
    distinct = np.unique(y)
    y, qy, width = np.searchsorted(distinct, y), np.searchsorted(distinct, qy), len(distinct) + 1
    out = np.full(len(qx), n)
    for k in range(n.bit_length()):
        asked, whole = np.flatnonzero(upto >> k & 1), n >> k << k
        if len(asked):
            keys = (np.arange(whole) >> k) * width + y[:whole]
            by = np.argsort(keys, kind="stable")
            least = np.minimum.accumulate(value[by].reshape(-1, 1 << k)[:, ::-1], axis=1)[:, ::-1].ravel()
            block = (upto[asked] >> k) - 1
            place = np.searchsorted(keys[by], block * width + qy[asked])
            there = place < (block + 1) << k
            out[asked[there]] = np.minimum(out[asked[there]], least[place[there]])
    return out


def largest_overlap(qs: np.ndarray, qe: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each interval (qs, qe) the index of the interval (s, e) that shares most with it, the first of equal ones, and how much; 0 and less is none.

    The best is one that holds the query, or the one that reaches furthest into it from
    either side, or the longest inside.
    """
    n = len(s)
    if not n or not len(qs):
        return np.zeros(len(qs), "int64"), np.zeros(len(qs), "int64")

    def ranks(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Indices by ``key``, the first of equal ones first, and the rank of each."""
        by = np.argsort(key, kind="stable")
        rank = np.empty(n, "int64")
        rank[by] = np.arange(n)
        return np.r_[by, 0], rank

    def reach(at: np.ndarray, q: np.ndarray, key: np.ndarray) -> np.ndarray:
        """Of those with at <= q the one with the least ``key``."""
        by, rank = ranks(key)
        order = np.argsort(at, kind="stable")
        return by[np.r_[n, np.minimum.accumulate(rank[order])][np.searchsorted(at[order], q, "right")]]

    holds = np.r_[np.arange(n), 0][least_dominating(s, e, np.arange(n), qs, qe)]
    by, rank = ranks(s - e)
    inside = by[least_dominating(-s, -e, rank, -qs, -qe)]
    tried = np.stack([holds, inside, reach(s, qs, -e), reach(-e, -qe, s)])
    over = np.minimum(e[tried], qe) - np.maximum(s[tried], qs)
    most = over.max(axis=0)
    return np.where(over == most, tried, n).min(axis=0), most
