"""Character BiLSTM with CRF transitions: trained in numpy, decoded in windows.

One layer.  A step of the LSTM takes STEP characters at once: their embeddings stand
side by side in its input, and its state scores the tags of each of them, so that
every character has its own tag while the recurrent product, which costs most, is
made once for all of them.  Characters are mapped to a closed alphabet (ASCII plus
classes for everything else), so the model's size does not depend on the corpus.

Decoding works on overlapping windows: the emissions of all windows that cover a
character are averaged, weighted by the distance to the window's edge, and one
Viterbi pass over the whole text reconciles them.  The emissions come from
onnxruntime if it can be imported (the trained weights as a graph of one LSTM), else
from numpy; both give the same figures.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np

KINDS = ("email", "phone", "id_number", "address", "name")
TAGS = ("O", *(f"B-{k}" for k in KINDS), *(f"I-{k}" for k in KINDS))
N = len(KINDS)
K = len(TAGS)
#: Ids 0 padding, 1..127 ASCII, then classes of other characters.
PAD, UPPER, LOWER, LETTER, DIGIT, SPACE, PUNCT, OTHER = 0, 128, 129, 130, 131, 132, 133, 134
VOCAB = 135
#: Characters of a step; windows and overlaps are multiples of it.
STEP = 4
WINDOW, OVERLAP = 384, 24
#: Places of the texts whose paths are stepped through together, each counted as long as the longest of them.
TOGETHER = 400_000
#: Long texts are cut about every PIECE places, somewhere among NEAR; about so many parts are stepped through together.
PIECE, NEAR, LANES = 48, 16, 3000


@lru_cache(maxsize=8192)
def _class_of(c: str) -> int:
    o = ord(c)
    if 0 < o < 128:
        return o
    base = unicodedata.normalize("NFKD", c)[0]
    if base != c and 0 < ord(base) < 128 and base.isalpha():
        return ord(base)
    cat = unicodedata.category(c)
    return {"Lu": UPPER, "Ll": LOWER, "Nd": DIGIT, "Zs": SPACE}.get(cat) or (LETTER if cat[0] == "L" else PUNCT if cat[0] in "PS" else OTHER)


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """Alphabet ids of the characters below U+3000; those above are looked up one by one."""
    return np.array([OTHER, *(_class_of(chr(o)) for o in range(1, 0x3000))], np.uint8)


def encode(text: str) -> np.ndarray:
    """Alphabet ids of a text, one for each code point."""
    a = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    t = _classes()
    out = t[np.minimum(a, len(t) - 1)]
    for k in np.flatnonzero(a >= len(t)):
        out[k] = _class_of(text[k])
    return out


def init(hidden: int, step: int = STEP, width: int = 10, seed: int = 7) -> dict[str, np.ndarray]:
    r = np.random.default_rng(seed)
    p = {
        "E": r.normal(0, 0.5, (VOCAB, width)),
        "W": r.normal(0, 1 / np.sqrt(step * width), (2, step * width, 4 * hidden)),
        "b": np.zeros((2, 4 * hidden)),
        "U": r.normal(0, 1 / np.sqrt(hidden), (2, hidden, 4 * hidden)) * 0.7,
        "O": r.normal(0, 0.1, (2 * hidden, step * K)),
        "c": np.zeros(step * K),
        "T": r.normal(0, 0.05, (K, K)),
    }
    p["b"][:, hidden : 2 * hidden] += 1.0  # forget gates start open
    return {k: v.astype(np.float32) for k, v in p.items()}


def _inputs(p: dict, X: np.ndarray) -> np.ndarray:
    """(B, steps, step * width) embeddings of the characters of each step; X is as wide as a whole number of steps."""
    B, T = X.shape
    width = p["W"].shape[1]
    return p["E"][X].reshape(B, T * p["E"].shape[1] // width, width)


def _states(p: dict, X: np.ndarray, keep: bool = False):
    """Hidden states (B, steps, 2H) of both directions; with keep also what the backward pass needs."""
    B, H = len(X), p["U"].shape[1]
    scale = np.ones(4 * H, np.float32)
    scale[: 3 * H] = 0.5  # sigmoid(x) = tanh(x / 2) / 2 + 1 / 2
    U = p["U"] * scale
    I = _inputs(p, X)  # noqa: E741
    n = I.shape[1]
    G = np.stack([(I @ p["W"][d] + p["b"][d]) * scale for d in (0, 1)])  # 2, B, steps, 4H
    h = np.zeros((2, B, H), np.float32)
    c = np.zeros((2, B, H), np.float32)
    out = np.empty((B, n, 2 * H), np.float32)
    trace = []
    for t in range(n):
        Z = np.matmul(h, U)
        Z[0] += G[0, :, t]
        Z[1] += G[1, :, n - 1 - t]
        np.tanh(Z, out=Z)
        S = Z[:, :, : 3 * H] * 0.5 + 0.5
        i, f, o, g = S[:, :, :H], S[:, :, H : 2 * H], S[:, :, 2 * H :], Z[:, :, 3 * H :]
        prev_c, prev_h = c, h
        c = f * c + i * g
        tc = np.tanh(c)
        h = o * tc
        out[:, t, :H] = h[0]
        out[:, n - 1 - t, H:] = h[1]
        if keep:
            trace.append((i, f, o, g, prev_c, prev_h, tc))
    return (out, trace, I) if keep else out


def emissions(p: dict, X: np.ndarray) -> np.ndarray:
    """Tag scores (B, T, K) of the characters X (B, T); T is a multiple of the step."""
    return (_states(p, X) @ p["O"] + p["c"]).reshape(*X.shape, K)


# -- the same as a graph for onnxruntime ------------------------------------------
def _varint(n: int) -> bytes:
    out = b""
    while n > 127:
        out += bytes([n & 127 | 128])
        n >>= 7
    return out + bytes([n])


def _field(number: int, value: int | bytes | str) -> bytes:
    """A field of a protocol-buffer message: a number, or text or bytes with their length."""
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    data = value.encode() if isinstance(value, str) else value
    return _varint(number << 3 | 2) + _varint(len(data)) + data


def _tensor(name: str, a: np.ndarray) -> bytes:
    kind = {"float32": 1, "int64": 7}[str(a.dtype)]
    return b"".join(_field(1, d) for d in a.shape) + _field(2, kind) + _field(8, name) + _field(9, a.tobytes())


def _node(op: str, ins: list[str], outs: list[str], **attributes: int | str | list[int]) -> bytes:
    out = b"".join(_field(1, x) for x in ins) + b"".join(_field(2, x) for x in outs) + _field(4, op)
    for k, v in attributes.items():
        a = _field(3, v) + _field(20, 2) if isinstance(v, int) else _field(4, v) + _field(20, 3) if isinstance(v, str) else b"".join(_field(8, x) for x in v) + _field(20, 7)
        out += _field(5, _field(1, k) + a)
    return out


def _value(name: str, kind: int, dims: list[int | str]) -> bytes:
    shape = b"".join(_field(1, _field(1, d) if isinstance(d, int) else _field(2, d)) for d in dims)
    return _field(1, name) + _field(2, _field(1, _field(1, kind) + _field(2, shape)))


def graph(p: dict) -> bytes:
    """The tagger as a graph in the ONNX format: x (steps, B, step) of ids to y (B * steps, step * K) of scores."""
    H = p["U"].shape[1]
    step = p["W"].shape[1] // p["E"].shape[1]
    order = np.r_[0:H, 2 * H : 3 * H, H : 2 * H, 3 * H : 4 * H]  # the format's gates: input, output, forget, cell
    turn = lambda a: np.ascontiguousarray(a[..., order].transpose(0, 2, 1))
    bias = np.concatenate([p["b"][:, order], np.zeros_like(p["b"])], axis=1)
    tensors = [
        _tensor("E", p["E"]), _tensor("W", turn(p["W"])), _tensor("R", turn(p["U"])), _tensor("b", bias), _tensor("O", p["O"]), _tensor("c", p["c"]),
        _tensor("flat", np.array([0, 0, p["W"].shape[1]], np.int64)), _tensor("both", np.array([-1, 2 * H], np.int64)),
    ]
    nodes = [
        _node("Gather", ["E", "x"], ["e"]), _node("Reshape", ["e", "flat"], ["i"]), _node("LSTM", ["i", "W", "R", "b"], ["h"], direction="bidirectional", hidden_size=H),
        _node("Transpose", ["h"], ["t"], perm=[2, 0, 1, 3]), _node("Reshape", ["t", "both"], ["s"]), _node("Gemm", ["s", "O", "c"], ["y"]),
    ]
    g = b"".join(_field(1, n) for n in nodes) + _field(2, "tagger") + b"".join(_field(5, t) for t in tensors) + _field(11, _value("x", 6, ["n", "b", step])) + _field(12, _value("y", 1, ["m", step * K]))
    return _field(1, 8) + _field(7, g) + _field(8, _field(1, "") + _field(2, 14))


class Runner:
    """Emissions of a model by onnxruntime on one thread, or by numpy where it is not installed."""

    def __init__(self, p: dict):
        self.p, self.session, self.T = p, None, settled(p["T"])
        self.step = p["W"].shape[1] // p["E"].shape[1]
        try:
            import onnxruntime
        except ImportError:
            return
        how = onnxruntime.SessionOptions()
        how.intra_op_num_threads = how.inter_op_num_threads = 1
        how.log_severity_level = 3
        self.session = onnxruntime.InferenceSession(graph(p), how, providers=["CPUExecutionProvider"])

    def __call__(self, X: np.ndarray) -> np.ndarray:
        """Tag scores (B, T, K)."""
        if self.session is None:
            return emissions(self.p, X)
        B, T = X.shape
        ids = np.ascontiguousarray(X.reshape(B, T // self.step, self.step).transpose(1, 0, 2).astype(np.int32))
        return self.session.run(None, {"x": ids})[0].reshape(B, T, K)


def _lse(a: np.ndarray, axis: int) -> np.ndarray:
    m = a.max(axis=axis, keepdims=True)
    return np.squeeze(m, axis) + np.log(np.exp(a - m).sum(axis=axis))


def loss_and_grads(p: dict, X: np.ndarray, Y: np.ndarray) -> tuple[float, dict]:
    """Negative log likelihood of the CRF for each character, and its gradients."""
    B, T = X.shape
    H = p["U"].shape[1]
    hs, trace, I = _states(p, X, keep=True)  # noqa: E741
    n = hs.shape[1]
    E = (hs @ p["O"] + p["c"]).reshape(B, T, K)
    A = np.empty((T, B, K), np.float32)
    A[0] = E[:, 0]
    for t in range(1, T):
        A[t] = _lse(A[t - 1][:, :, None] + p["T"][None], 1) + E[:, t]
    logz = _lse(A[-1], 1)
    Bk = np.zeros((T, B, K), np.float32)
    dT = np.zeros((K, K), np.float32)
    for t in range(T - 2, -1, -1):
        nxt = Bk[t + 1] + E[:, t + 1]
        Bk[t] = _lse(p["T"][None] + nxt[:, None, :], 2)
        dT += np.exp(A[t][:, :, None] + p["T"][None] + nxt[:, None, :] - logz[:, None, None]).sum(0)
    dE = np.exp(A + Bk - logz[None, :, None]).transpose(1, 0, 2).copy()
    rows, cols = np.arange(B)[:, None], np.arange(T)[None]
    gold = E[rows, cols, Y].sum(1) + p["T"][Y[:, :-1], Y[:, 1:]].sum(1)
    dE[rows, cols, Y] -= 1
    np.add.at(dT, (Y[:, :-1].ravel(), Y[:, 1:].ravel()), -1)
    size = float(B * T)
    dE = (dE / size).reshape(B, n, -1)
    g = {"T": dT / size, "c": dE.sum((0, 1)), "O": np.tensordot(hs, dE, ((0, 1), (0, 1)))}
    dH = dE @ p["O"].T
    dU = np.zeros_like(p["U"])
    dh, dc = np.zeros((2, B, H), np.float32), np.zeros((2, B, H), np.float32)
    U_t = p["U"].transpose(0, 2, 1).copy()
    D = np.empty((2, n, B, 4 * H), np.float32)  # by place in the text
    for t in range(n - 1, -1, -1):
        i, f, o, gg, prev_c, prev_h, tc = trace[t]
        dh[0] += dH[:, t, :H]
        dh[1] += dH[:, n - 1 - t, H:]
        dc += dh * o * (1 - tc * tc)
        d = np.concatenate([dc * gg * i * (1 - i), dc * prev_c * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - gg * gg)], axis=2)
        dU += np.matmul(prev_h.transpose(0, 2, 1), d)
        D[0, t], D[1, n - 1 - t] = d[0], d[1]
        dh = np.matmul(d, U_t)
        dc = dc * f
    g["U"] = dU
    g["b"] = D.sum((1, 2))
    flat = np.ascontiguousarray(I.transpose(1, 0, 2)).reshape(n * B, -1)
    D = D.reshape(2, n * B, 4 * H)
    g["W"] = np.stack([flat.T @ D[d] for d in (0, 1)])
    dI = sum(D[d] @ p["W"][d].T for d in (0, 1)).reshape(n, B, -1).transpose(1, 0, 2).reshape(B * T, -1)
    x = X.ravel()
    order = np.argsort(x, kind="stable")
    starts = np.flatnonzero(np.r_[True, np.diff(x[order]) != 0])
    g["E"] = np.zeros_like(p["E"])
    g["E"][x[order][starts]] = np.add.reduceat(dI[order], starts, axis=0)
    return float((logz - gold).sum() / size), g


class Adam:
    def __init__(self, p: dict):
        self.m = {k: np.zeros_like(v) for k, v in p.items()}
        self.v = {k: np.zeros_like(v) for k, v in p.items()}
        self.t = 0

    def step(self, p: dict, g: dict, lr: float, clip: float = 1.0) -> None:
        self.t += 1
        norm = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
        s = min(1.0, clip / (norm + 1e-9))
        for k in p:
            x = g[k] * s
            self.m[k] = 0.9 * self.m[k] + 0.1 * x
            self.v[k] = 0.999 * self.v[k] + 0.001 * x * x
            p[k] -= lr * (self.m[k] / (1 - 0.9**self.t)) / (np.sqrt(self.v[k] / (1 - 0.999**self.t)) + 1e-8)


def _windows(n: int) -> list[int]:
    """Starts of the windows over a text of n characters."""
    step = WINDOW - 2 * OVERLAP
    return list(range(0, max(1, n - 2 * OVERLAP), step))


#: Weight of a window's emissions by the position in it: low where context is cut off.
_EDGE = np.minimum(np.minimum(np.arange(WINDOW), np.arange(WINDOW)[::-1]) + 1, OVERLAP).astype(np.float32) / OVERLAP


def decode(p: dict | Runner, texts: list[str], batch: int = 16) -> list[list[tuple[int, int, str]]]:
    """Spans (start, end, kind) of each text.  Empty texts have none; a text of any length is decoded whole."""
    run = p if isinstance(p, Runner) else Runner(p)
    size = [len(t) for t in texts]
    first = np.cumsum([0, *size])  # the texts' characters stand one behind the other
    ids = encode("".join(texts))
    where = np.array(sorted((min(WINDOW, n - s), k, s) for k, n in enumerate(size) if n for s in _windows(n)), np.int64).reshape(-1, 3)
    total = np.zeros((len(ids), K), np.float32)
    edge = _EDGE[:OVERLAP, None]
    ends = np.array(size, np.int64)
    # Behind a text there is always some padding, by which the tagger knows its end.
    steps = -(-where[:, 0] // run.step) + ((where[:, 0] % run.step == 0) & (where[:, 0] + where[:, 2] == ends[where[:, 1]]))
    where, steps, b = where[o := np.argsort(steps, kind="stable")], steps[o], 0
    while b < len(where):
        # Only windows of as many steps, so that what is found in a text depends on no other's length.
        part = where[b : min(b + batch, int(np.searchsorted(steps, steps[b], side="right")))]
        place = np.arange(steps[b] * run.step)
        b += len(part)
        starts = first[part[:, 1]] + part[:, 2]
        X = ids.take(np.minimum(starts[:, None] + place, len(ids) - 1))
        X[place >= part[:, :1]] = PAD
        E = run(X)
        if steps[b - 1] * run.step == WINDOW:
            E[part[:, 2] + WINDOW < ends[part[:, 1]], -OVERLAP:] *= edge[::-1]
        if part[:, 2].any():
            E[part[:, 2] > 0, :OVERLAP] *= edge
        for r, (at, (n, k, _)) in enumerate(zip(starts.tolist(), part.tolist())):
            if size[k] <= WINDOW:  # the only window of its text
                total[at : at + n] = E[r, :n]
            else:
                total[at : at + n] += E[r, :n]
    again = where[where[:, 2] > 0]
    shared = (first[again[:, 1]] + again[:, 2])[:, None] + np.arange(2 * OVERLAP)
    total[shared] /= (_EDGE[-2 * OVERLAP :] + _EDGE[: 2 * OVERLAP])[:, None]
    return _spans(viterbi(total, first, run.T), first)


def viterbi(E: np.ndarray, first: np.ndarray, T: np.ndarray) -> np.ndarray:
    """Best tag paths of texts whose emissions stand one behind the other, from first[k] to first[k + 1]."""
    out = np.zeros(len(E), np.uint8)
    spans = sorted(((int(a), int(b)) for a, b in zip(first, first[1:]) if a < b), key=lambda x: x[0] - x[1])
    k = 0
    while k < len(spans):  # many short texts, or few long ones: what is held at a time is bounded
        part = spans[k : k + max(1, TOGETHER // (spans[k][1] - spans[k][0]))]
        k += len(part)
        for (a, b), path in zip(part, _viterbi([E[a:b] for a, b in part], T)):
            out[a:b] = path
    return out


def settled(T: np.ndarray) -> np.ndarray:
    """The transitions that decoding uses: an I tag follows only a tag of its own kind, and a B tag behind another span's costs the same for all.

    Neither occurs in labels, so training has nothing to tell about them.
    """
    T = T.copy()
    T[1:, 1 : N + 1] = T[1:, 1 : N + 1].mean()
    T[0, N + 1 :] = -1e4
    inner = T[1:, N + 1 :].copy()
    T[1:, N + 1 :] = -1e4
    for k in range(N):
        T[1 + k, N + 1 + k], T[N + 1 + k, N + 1 + k] = inner[k, k], inner[N + k, k]
    return T


def _viterbi(E: list[np.ndarray], T: np.ndarray) -> list[np.ndarray]:
    """Best tag paths under settled transitions.

    Long texts are cut where their best path surely has the tag O (_sure): given that, the
    parts on both sides of the place don't touch each other's paths.  Texts and parts of
    about one length are then stepped through together.
    """
    n = np.array([len(e) for e in E])
    all_ = E[0] if len(E) == 1 else np.concatenate(E)
    starts = np.cumsum(n) - n
    at = np.concatenate([np.zeros(0, np.int64), *(np.arange(a + PIECE - NEAR // 2, a + k - PIECE // 2 - NEAR, PIECE) for a, k in zip(starts.tolist(), n.tolist()) if k > PIECE)])
    cut = at[:0]
    for _ in range(2):  # where there is none, once more among the next
        found = _sure(all_, at, T)
        cut, at = np.concatenate([cut, (at + found)[found >= 0]]), at[found < 0] + NEAR
    # A part begins and ends with the places of its cuts.
    a, b = np.concatenate([starts, cut]), np.concatenate([starts + n, cut + 1])
    a, b = np.sort(a), np.sort(b)
    is_cut = np.zeros(len(all_), bool)
    is_cut[cut] = True
    left, right = is_cut[a], is_cut[b - 1]
    order = np.argsort(a - b, kind="stable")
    out = np.zeros(len(all_), np.uint8)
    for o in np.array_split(order, max(1, round(len(order) / LANES))):
        _stepped(all_, a[o], b[o] - a[o], left[o], right[o], T, out)
    return [out[x : x + k] for x, k in zip(starts.tolist(), n.tolist())]


def _sure(E: np.ndarray, at: np.ndarray, T: np.ndarray) -> np.ndarray:
    """In each of the windows of NEAR places from at on, which lie within texts: a place at which every best path has the tag O, -1 if none is surely so.

    Nothing is taken for granted about what stands outside of a window.  Step by step,
    u bounds how much better than one in O a path up to here can be that ends in another
    tag, whatever came before; r how much better one can go on from that tag.  A place is
    sure if the two are below 0 together, for every other tag.
    """
    S = np.ascontiguousarray(E.take(at + np.arange(NEAR)[:, None], 0).transpose(0, 2, 1))
    D = S[:, 1:] - S[:, :1]
    stay, again, begin = T[0, 0], T[1, 1], T[0, 1 : N + 1, None]
    first_on, on = np.diagonal(T[1 : N + 1, N + 1 :])[:, None], np.diagonal(T[N + 1 :, N + 1 :])[:, None]
    leave = T[1:, :1] - stay
    U = np.empty_like(D)
    u = np.full(D.shape[1:], np.inf, np.float32)
    for t in range(NEAR):
        v = np.minimum(u, -leave)  # a path in O has stayed there or has left the same tag, whichever is better
        u = U[t]
        np.add(D[t, :N], np.maximum(begin, v.max(0) + again) - stay, out=u[:N])
        np.add(D[t, N:], np.maximum(v[:N] + first_on, v[N:] + on) - stay, out=u[N:])
    inner = np.maximum(np.maximum(T[N + 1 :, :1] - T[1 : N + 1, :1], on - first_on), 0)  # how much better an I tag can go on than its B tag
    stop = np.maximum(leave, again - begin.min())
    r = np.full(D.shape[1:], np.inf, np.float32)
    best = np.full(len(at), -1)
    for t in range(NEAR - 2, NEAR // 4, -1):
        i = np.minimum(S[t + 1, N + 1 :] - S[t + 1, 1 : N + 1] + inner - begin, D[t + 1, N:] + r[N:] - stay)
        r = np.maximum(stop, np.concatenate([i + first_on, i + on]))
        best[((U[t] + r).max(0) < -0.05) & (best < 0)] = t  # 0.05: rounding is far less
    return best


def _stepped(E: np.ndarray, a: np.ndarray, n: np.ndarray, left: np.ndarray, right: np.ndarray, T: np.ndarray, out: np.ndarray) -> None:
    """Writes the best paths of the parts of E from a on, n places long and the longest first; left, right: their first, last tag is O for sure.

    Parts are the inner axis, so that each step is a few operations on long rows; what
    can come before a tag is looked at only once where it is the same for several, and
    which tag a span stands behind only where one does.
    """
    B, L = len(n), int(n[0])
    alive = np.searchsorted(-n, -np.arange(L + 1), side="left")  # parts longer than t stand before it
    S = _room(L * K * B).reshape(L, K, B)  # emissions, then the best scores of paths that end in a tag
    first_of = np.empty((L, K, B), bool)  # whether the first of _BEFORE is the best tag before
    for t in range(0, L, 16):
        for r in range(0, alive[t], 256):  # so many fit the cache
            at = np.minimum(a[r : min(r + 256, alive[t]), None] + np.arange(t, min(t + 16, L)), len(E) - 1)
            S[t : t + 16, :, r : r + len(at)] = E.take(at, 0).transpose(1, 2, 0)
    S[0, 1:, left] = -1e9
    stay, out_of, into, again = T[0, 0], T[1:, :1], T[0, 1 : N + 1, None], T[1, 1]
    first_on, on = np.diagonal(T[1 : N + 1, N + 1 :])[:, None], np.diagonal(T[N + 1 :, N + 1 :])[:, None]
    room, X, Y = np.empty((K - 1, B), np.float32), np.empty((K, B), np.float32), np.empty((K, B), np.float32)
    k = 0
    for t in range(1, L):
        if k != alive[t]:
            k = alive[t]
            z, x, y = room[:, :k], X[:, :k], Y[:, :k]
            x_o, x_b, x_i, y_o, y_b, y_i = x[0], x[1 : N + 1], x[N + 1 :], y[0], y[1 : N + 1], y[N + 1 :]
        p, q = S[t - 1, :, :k], S[t, :, :k]
        np.add(p[0], stay, out=x_o)
        np.add(p[1:], out_of, out=z)
        np.max(z, axis=0, out=y_o)
        np.add(p[0], into, out=x_b)
        np.add(np.max(p[1:], axis=0), again, out=y_b)
        np.add(p[1 : N + 1], first_on, out=x_i)
        np.add(p[N + 1 :], on, out=y_i)
        np.greater_equal(x, y, out=first_of[t, :, :k])
        q += np.maximum(x, y, out=x)
    cur, lane = np.zeros(B, np.int64), np.arange(B)
    for t in range(L - 1, -1, -1):
        on_, k = alive[t + 1], alive[t]
        if on_:
            tag = _BEFORE.take(first_of[t + 1].ravel().take(cur[:on_] * B + lane[:on_]) * K + cur[:on_])
            if tag.min() < 0:
                c = np.flatnonzero(tag < 0)
                tag[c] = 1 + (S[t, 1:, c] + np.where(cur[c, None] == 0, T[1:, 0], again)).argmax(1)
            cur[:on_] = tag
        if on_ < k:
            cur[on_:k] = np.where(right[on_:k], 0, S[t, :, on_:k].argmax(0))
        out[a[:k] + t] = cur[:k]


_ROOM: list[np.ndarray] = [np.empty(0, np.float32)]


def _room(n: int) -> np.ndarray:
    """Room for n scores, the same each time: a system that clears new memory would take as long as a step."""
    if len(_ROOM[0]) < n:
        _ROOM[0] = np.empty(n, np.float32)
    return _ROOM[0][:n]


#: The tags that can stand before O, a B tag and an I tag: the second, then the first of two choices; -1 for the best tag but O.
_BEFORE = np.array([*[-1] * (N + 1), *range(N + 1, K), *[0] * (N + 1), *range(1, N + 1)])


def _spans(tags: np.ndarray, first: np.ndarray) -> list[list[tuple[int, int, str]]]:
    """Maximal runs of one kind in each of the texts that stand from first[k] to first[k + 1]; a B tag begins a new run."""
    out: list[list[tuple[int, int, str]]] = [[] for _ in first[1:]]
    at = np.flatnonzero(tags)
    if not len(at):
        return out
    kind, text = (tags[at] - 1) % N, np.searchsorted(first, at, side="right") - 1
    k = np.flatnonzero(np.r_[True, (at[1:] - at[:-1] > 1) | (kind[1:] != kind[:-1]) | (text[1:] != text[:-1]) | (tags[at[1:]] <= N)])
    ends = at[np.r_[k[1:] - 1, len(at) - 1]] + 1
    base = first[text[k]]
    for t, s, e, x in zip(text[k].tolist(), (at[k] - base).tolist(), (ends - base).tolist(), kind[k].tolist()):
        out[t].append((s, e, KINDS[x]))
    return out


def save(p: dict, path: str) -> None:
    np.savez_compressed(path, **{k: v.astype(np.float16) for k, v in p.items()})


def load(path: str) -> dict:
    with np.load(path) as z:
        return {k: z[k].astype(np.float32) for k in z.files}
