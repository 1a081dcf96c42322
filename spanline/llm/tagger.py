"""A character-level bidirectional LSTM with CRF transitions, in numpy alone."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

TYPES = ("email", "phone", "id_number", "address", "person")
#: Outside, then begin and inside of each type.
TAGS = ("O", *(f"{p}-{t}" for t in TYPES for p in "BI"))
#: Characters the model tells apart, in lower case; the rest is one unknown per shape.
ALPHABET = "abcdefghijklmnopqrstuvwxyzäöüßéèабвгдеёжзийклмнопрстуфхцчшщъыьэюяіїєґ0123456789 .,:;-+()[]/@_'\"«»„“”—–!?°%^*|<>=¬№\n"
INDEX = {c: i + 2 for i, c in enumerate(ALPHABET)}
SHAPES = 5
EMBED, HIDDEN = 16, 40
#: Texts are cut into windows of ``WINDOW`` characters that overlap by ``OVERLAP``.
WINDOW, OVERLAP = 128, 48


def encode(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Character and shape ids; 0 is padding, 1 an unknown character."""
    ids = np.fromiter((INDEX.get(c if c in INDEX else c.lower(), 1) for c in text), dtype=np.int32, count=len(text))
    shapes = np.fromiter((0 if c.isupper() else 1 if c.isalpha() else 2 if c.isdigit() else 3 if c.isspace() else 4 for c in text), dtype=np.int32, count=len(text))
    return ids, shapes


def sigmoid(x: np.ndarray) -> np.ndarray:
    """Logistic function by way of tanh, which does not overflow."""
    return 0.5 * np.tanh(0.5 * x) + 0.5


def fresh(seed: int = 1) -> dict[str, np.ndarray]:
    """Random weights."""
    r = np.random.default_rng(seed)
    k = len(TAGS)
    p = {"emb": r.normal(0, 0.3, (len(ALPHABET) + 2, EMBED)), "out": r.normal(0, 0.15, (2 * HIDDEN, k)), "bias": np.zeros(k), "trans": np.zeros((k, k)), "first": np.zeros(k)}
    for d in "fb":
        p[f"w{d}"] = r.normal(0, 0.15, (EMBED + SHAPES, 4 * HIDDEN))
        p[f"u{d}"] = r.normal(0, 0.12, (HIDDEN, 4 * HIDDEN))
        b = np.zeros(4 * HIDDEN)
        b[HIDDEN : 2 * HIDDEN] = 1.0
        p[f"c{d}"] = b
    return {n: v.astype(np.float32) for n, v in p.items()}


def _direction(x: np.ndarray, mask: np.ndarray, p: dict, d: str, keep: bool) -> tuple[np.ndarray, list]:
    """One LSTM over time-major input; gates in the order in, forget, out, cell."""
    t, n, _ = x.shape
    h = np.zeros((n, HIDDEN), np.float32)
    c = np.zeros((n, HIDDEN), np.float32)
    out = np.zeros((t, n, HIDDEN), np.float32)
    pre = x @ p[f"w{d}"] + p[f"c{d}"]
    saved = []
    u = p[f"u{d}"]
    for i in range(t) if d == "f" else range(t - 1, -1, -1):
        z = pre[i] + h @ u
        gates = sigmoid(z[:, : 3 * HIDDEN])
        g = np.tanh(z[:, 3 * HIDDEN :])
        a, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
        m = mask[i][:, None]
        c_new = f * c + a * g
        tc = np.tanh(c_new)
        h_new = o * tc
        if keep:
            saved.append((i, h, c, a, f, o, g, tc, m))
        h = m * h_new + (1 - m) * h
        c = m * c_new + (1 - m) * c
        out[i] = h * m
    return out, saved


def forward(p: dict, ids: np.ndarray, shapes: np.ndarray, keep: bool = False):
    """Tag scores (time, batch, tags) of padded id matrices (batch, time)."""
    mask = (ids.T != 0).astype(np.float32)
    x = np.concatenate([p["emb"][ids.T], np.eye(SHAPES, dtype=np.float32)[shapes.T]], axis=2)
    hf, sf = _direction(x, mask, p, "f", keep)
    hb, sb = _direction(x, mask, p, "b", keep)
    h = np.concatenate([hf, hb], axis=2)
    scores = h @ p["out"] + p["bias"]
    return scores, (x, mask, h, sf, sb)


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis=axis, keepdims=True)
    return np.squeeze(m, axis) + np.log(np.exp(x - m).sum(axis=axis))


def crf_loss(p: dict, scores: np.ndarray, mask: np.ndarray, tags: np.ndarray):
    """Negative log likelihood of tag paths, and its gradients."""
    t, n, k = scores.shape
    trans, first = p["trans"], p["first"]
    alpha = np.zeros_like(scores)
    alpha[0] = scores[0] + first
    for i in range(1, t):
        new = _lse(alpha[i - 1][:, :, None] + trans[None], 1) + scores[i]
        m = mask[i][:, None]
        alpha[i] = m * new + (1 - m) * alpha[i - 1]
    log_z = _lse(alpha[-1], 1)
    beta = np.zeros_like(scores)
    for i in range(t - 2, -1, -1):
        new = _lse(trans[None] + (scores[i + 1] + beta[i + 1])[:, None, :], 2)
        m = mask[i + 1][:, None]
        beta[i] = m * new + (1 - m) * beta[i + 1]
    marginal = np.exp(alpha + beta - log_z[None, :, None]) * mask[:, :, None]
    rows = np.arange(n)
    gold = first[tags[0]] + scores[0, rows, tags[0]]
    d_trans = np.zeros_like(trans)
    for i in range(1, t):
        m = mask[i]
        gold = gold + m * (trans[tags[i - 1], tags[i]] + scores[i, rows, tags[i]])
        joint = alpha[i - 1][:, :, None] + trans[None] + (scores[i] + beta[i])[:, None, :] - log_z[:, None, None]
        d_trans += (np.exp(joint) * m[:, None, None]).sum(axis=0)
        np.add.at(d_trans, (tags[i - 1], tags[i]), -m)
    d_scores = marginal.copy()
    np.add.at(d_scores, (np.arange(t)[:, None].repeat(n, 1), rows[None].repeat(t, 0), tags), -mask)
    d_first = marginal[0].sum(axis=0)
    np.add.at(d_first, tags[0], -mask[0])
    return float((log_z - gold).sum()), d_scores / n, d_trans / n, d_first / n


def backward(p: dict, ids: np.ndarray, kept, d_scores: np.ndarray) -> dict[str, np.ndarray]:
    """Gradients of all weights but the transitions, through time."""
    x, mask, h, sf, sb = kept
    g = {"out": np.tensordot(h, d_scores, axes=([0, 1], [0, 1])), "bias": d_scores.sum(axis=(0, 1))}
    dh_all = d_scores @ p["out"].T
    dx = np.zeros_like(x)
    for d, saved, part in (("f", sf, dh_all[:, :, :HIDDEN]), ("b", sb, dh_all[:, :, HIDDEN:])):
        dz_all = np.zeros((x.shape[0], x.shape[1], 4 * HIDDEN), np.float32)
        du = np.zeros_like(p[f"u{d}"])
        dh = np.zeros((x.shape[1], HIDDEN), np.float32)
        dc = np.zeros_like(dh)
        for i, h0, c0, a, f, o, gg, tc, m in reversed(saved):
            dh = dh + part[i] * m
            dh_new, dc_new = dh * m, dc * m
            dc_new = dc_new + dh_new * o * (1 - tc * tc)
            dz = np.concatenate([dc_new * gg * a * (1 - a), dc_new * c0 * f * (1 - f), dh_new * tc * o * (1 - o), dc_new * a * (1 - gg * gg)], axis=1)
            dz_all[i] = dz
            du += h0.T @ dz
            dh = dz @ p[f"u{d}"].T + dh * (1 - m)
            dc = dc_new * f + dc * (1 - m)
        g[f"w{d}"] = np.tensordot(x, dz_all, axes=([0, 1], [0, 1]))
        g[f"u{d}"], g[f"c{d}"] = du, dz_all.sum(axis=(0, 1))
        dx += dz_all @ p[f"w{d}"].T
    emb = np.zeros_like(p["emb"])
    np.add.at(emb, ids.T, dx[:, :, :EMBED])
    g["emb"] = emb
    return g


def pad(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Padded id and shape matrices of texts."""
    n = max(map(len, texts))
    ids, shapes = np.zeros((len(texts), n), np.int32), np.zeros((len(texts), n), np.int32)
    for i, t in enumerate(texts):
        a, b = encode(t)
        ids[i, : len(t)], shapes[i, : len(t)] = a, b
    return ids, shapes


def train(texts: list[str], tags: list[list[int]], epochs: int = 8, batch: int = 64, rate: float = 0.004, seed: int = 1, start: dict | None = None, note=None) -> dict[str, np.ndarray]:
    """Weights fitted to labelled texts by Adam with a falling rate."""
    p = start or fresh(seed)
    m1 = {k: np.zeros_like(v) for k, v in p.items()}
    m2 = {k: np.zeros_like(v) for k, v in p.items()}
    r = np.random.default_rng(seed)
    order = sorted(range(len(texts)), key=lambda i: len(texts[i]))
    batches = [order[i : i + batch] for i in range(0, len(order), batch)]
    step, total = 0, epochs * len(batches)
    for epoch in range(epochs):
        loss = 0.0
        for j in r.permutation(len(batches)):
            rows = batches[j]
            ids, shapes = pad([texts[i] for i in rows])
            gold = np.zeros_like(ids)
            for k, i in enumerate(rows):
                gold[k, : len(tags[i])] = tags[i]
            scores, kept = forward(p, ids, shapes, keep=True)
            value, d_scores, d_trans, d_first = crf_loss(p, scores, kept[1], gold.T)
            loss += value
            g = backward(p, ids, kept, d_scores.astype(np.float32)) | {"trans": d_trans, "first": d_first}
            norm = float(np.sqrt(sum((v.astype(np.float64) ** 2).sum() for v in g.values())))
            step += 1
            lr = rate * (1 - step / (total + 1)) * min(1.0, step / 50)
            for k, v in g.items():
                v = v * min(1.0, 5.0 / (norm + 1e-9))
                m1[k] = 0.9 * m1[k] + 0.1 * v
                m2[k] = 0.999 * m2[k] + 0.001 * v * v
                p[k] = (p[k] - lr * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        if note:
            note(epoch, loss / len(texts))
    return p


def viterbi(p: dict, scores: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Best tag paths (time, batch) of stitched scores."""
    t, n, k = scores.shape
    best = scores[0] + p["first"]
    back = np.zeros((t, n, k), np.int8)
    for i in range(1, t):
        every = best[:, :, None] + p["trans"][None]
        arg = every.argmax(axis=1)
        new = np.take_along_axis(every, arg[:, None, :], 1)[:, 0] + scores[i]
        m = mask[i][:, None] > 0
        back[i] = np.where(m, arg, np.arange(k)[None])
        best = np.where(m, new, best)
    path = np.zeros((t, n), np.int64)
    path[-1] = best.argmax(axis=1)
    rows = np.arange(n)
    for i in range(t - 1, 0, -1):
        path[i - 1] = back[i, rows, path[i]]
    return path


def _windows(length: int) -> list[tuple[int, int]]:
    if length <= WINDOW:
        return [(0, length)]
    step = WINDOW - OVERLAP
    starts = list(range(0, length - WINDOW, step)) + [length - WINDOW]
    return [(s, s + WINDOW) for s in starts]


def tag(p: dict, texts: list[str], batch: int = 256) -> list[list[tuple[int, int, str]]]:
    """Entities of every text as (start, end, type).

    Long texts are scored in overlapping windows. Where windows overlap, their
    scores are reconciled with weights that fall towards a window's cut edges,
    and the whole text is then decoded as one path.
    """
    jobs = [(i, a, b) for i, t in enumerate(texts) for a, b in _windows(len(t)) if b > a]
    jobs.sort(key=lambda j: j[2] - j[1])
    total = [np.zeros((len(t), len(TAGS)), np.float32) for t in texts]
    weight = [np.zeros((len(t), 1), np.float32) for t in texts]
    for k in range(0, len(jobs), batch):
        part = jobs[k : k + batch]
        ids, shapes = pad([texts[i][a:b] for i, a, b in part])
        scores, _ = forward(p, ids, shapes)
        for col, (i, a, b) in enumerate(part):
            n = b - a
            w = np.ones(n, np.float32)
            ramp = np.linspace(0.05, 1, OVERLAP, dtype=np.float32)
            if a > 0:
                w[:OVERLAP] = ramp
            if b < len(texts[i]):
                w[-OVERLAP:] = np.minimum(w[-OVERLAP:], ramp[::-1])
            total[i][a:b] += scores[:n, col] * w[:, None]
            weight[i][a:b] += w[:, None]
    out: list[list[tuple[int, int, str]]] = [[] for _ in texts]
    order = sorted((i for i, t in enumerate(texts) if t), key=lambda i: len(texts[i]))
    k = 0
    while k < len(order):
        part = order[k : k + batch]
        if len(texts[part[-1]]) > 4096:  # very long texts are decoded one by one
            part = order[k : k + 1]
        k += len(part)
        t = len(texts[part[-1]])
        scores = np.zeros((t, len(part), len(TAGS)), np.float32)
        mask = np.zeros((t, len(part)), np.float32)
        for col, i in enumerate(part):
            n = len(texts[i])
            scores[:n, col], mask[:n, col] = total[i] / weight[i], 1
        paths = viterbi(p, scores, mask)
        for col, i in enumerate(part):
            out[i] = entities(paths[: len(texts[i]), col])
    return out


def entities(path: np.ndarray) -> list[tuple[int, int, str]]:
    """Runs of tags as (start, end, type)."""
    out, start, kind = [], 0, None
    for i, t in enumerate([*path.tolist(), 0]):
        begins, this = t % 2 == 1, TYPES[(t - 1) // 2] if t else None
        if kind is not None and (this != kind or begins):
            out.append((start, i, kind))
            kind = None
        if this is not None and kind is None:
            start, kind = i, this
    return out


def save(p: dict, path: str) -> None:
    """Weights in half precision."""
    np.savez_compressed(path, **{k: v.astype(np.float16) for k, v in p.items()})


@lru_cache(maxsize=2)
def load_weights(path: str) -> dict[str, np.ndarray]:
    """Weights at ``path``, once a worker."""
    with np.load(path) as f:
        return {k: f[k].astype(np.float32) for k in f.files}
