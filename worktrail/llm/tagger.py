"""A character tagger in numpy: bidirectional LSTM with CRF transitions.

It knows arrays of characters only; ``pii`` cuts texts of any length into windows and
deals with nulls. Of paths with equal scores the one of the smaller label stays.
"""

import numpy as np

EMBED, HIDDEN = 12, 16
PAD, OTHER_LETTER, OTHER, BREAK = 0, 1, 2, 3
CLASSES = 4 + 95


def codes(text):
    """Class of each character: printable ASCII on its own, the rest in a few groups."""
    raw = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    out = np.full(len(raw), OTHER, np.int64)
    out[raw > 127] = OTHER_LETTER
    out[raw < 32] = BREAK
    plain = (raw >= 32) & (raw < 127)
    out[plain] = raw[plain] - 32 + 4
    return out


def sigmoid(x):
    return 1 / (1 + np.exp(-x))


def logsumexp(x, axis):
    top = x.max(axis, keepdims=True)
    return (np.log(np.exp(x - top).sum(axis, keepdims=True)) + top).squeeze(axis)


class Tagger:
    """Emissions of windows of characters [windows, length], and paths through them.

    Both directions are one array operation per step: weights have a leading
    axis of two, and the second direction reads its input backwards.
    """

    def __init__(self, labels, seed=0):
        rng = np.random.default_rng(seed)
        k, h, d = labels, HIDDEN, EMBED

        def normal(*shape, scale):
            return (rng.standard_normal(shape) * scale).astype(np.float32)

        bias = np.zeros((2, 1, 4 * h), np.float32)
        bias[:, :, h:2 * h] = 1  # forget gates start open
        self.p = {"embed": normal(CLASSES, d, scale=0.5), "w": normal(2, d, 4 * h, scale=d ** -0.5),
                  "u": normal(2, h, 4 * h, scale=h ** -0.5), "b": bias,
                  "out": normal(2, h, k, scale=h ** -0.5), "out_b": np.zeros(k, np.float32),
                  "move": np.zeros((k, k), np.float32), "start": np.zeros(k, np.float32)}

    def forward(self, x, keep=False):
        p, h = self.p, HIDDEN
        n, length = x.shape
        both = np.stack([x, x[:, ::-1]])
        inputs = p["embed"][both] @ p["w"][:, None] + p["b"][:, None]
        hidden, cell = np.zeros((2, n, h), np.float32), np.zeros((2, n, h), np.float32)
        states, saved = np.empty((2, n, length, h), np.float32), []
        for t in range(length):
            z = inputs[:, :, t] + hidden @ p["u"]
            gate = sigmoid(np.concatenate([z[..., :2 * h], z[..., 3 * h:]], -1))
            i, f, o = gate[..., :h], gate[..., h:2 * h], gate[..., 2 * h:]
            g = np.tanh(z[..., 2 * h:3 * h])
            before = cell
            cell = f * cell + i * g
            squashed = np.tanh(cell)
            if keep:
                saved.append((i, f, o, g, before, squashed, hidden))
            hidden = o * squashed
            states[:, :, t] = hidden
        said = states[0] @ p["out"][0] + states[1][:, ::-1] @ p["out"][1] + p["out_b"]
        return said, (both, states, saved)

    def loss(self, x, y):
        """Mean negative log likelihood of label paths, and the gradients."""
        p, h = self.p, HIDDEN
        n, length = x.shape
        em, (both, states, saved) = self.forward(x, keep=True)
        move, row = p["move"], np.arange(n)
        ahead = np.empty_like(em)
        ahead[:, 0] = p["start"] + em[:, 0]
        for t in range(1, length):
            ahead[:, t] = logsumexp(ahead[:, t - 1, :, None] + move, 1) + em[:, t]
        back = np.zeros_like(em)
        for t in range(length - 2, -1, -1):
            back[:, t] = logsumexp(move + (em[:, t + 1] + back[:, t + 1])[:, None], 2)
        total = logsumexp(ahead[:, -1], 1)
        d_em = np.exp(ahead + back - total[:, None, None])
        pairs = np.exp(ahead[:, :-1, :, None] + move + (em + back)[:, 1:, None]
                       - total[:, None, None, None])
        gold = p["start"][y[:, 0]] + em[row[:, None], np.arange(length), y].sum(1) + move[
            y[:, :-1], y[:, 1:]].sum(1)
        g = {k: np.zeros_like(v) for k, v in p.items()}
        g["start"] = d_em[:, 0].sum(0)
        np.add.at(g["start"], y[:, 0], -1)
        g["move"] = pairs.sum((0, 1))
        np.add.at(g["move"], (y[:, :-1], y[:, 1:]), -1)
        d_em[row[:, None], np.arange(length), y] -= 1

        two = np.stack([d_em, d_em[:, ::-1]])
        g["out"] = np.einsum("anth,antk->ahk", states, two)
        g["out_b"] = d_em.sum((0, 1))
        d_states = two @ p["out"].transpose(0, 2, 1)[:, None]
        d_in = np.empty((2, n, length, 4 * h), np.float32)
        d_hidden, d_cell = np.zeros((2, n, h), np.float32), np.zeros((2, n, h), np.float32)
        for t in range(length - 1, -1, -1):
            i, f, o, c, before, squashed, hidden = saved[t]
            d = d_states[:, :, t] + d_hidden
            dc = d * o * (1 - squashed ** 2) + d_cell
            z = d_in[:, :, t]
            z[..., :h] = dc * c * i * (1 - i)
            z[..., h:2 * h] = dc * before * f * (1 - f)
            z[..., 2 * h:3 * h] = dc * i * (1 - c ** 2)
            z[..., 3 * h:] = d * squashed * o * (1 - o)
            g["u"] += hidden.transpose(0, 2, 1) @ z
            d_hidden, d_cell = z @ p["u"].transpose(0, 2, 1), dc * f
        g["b"] = d_in.sum((1, 2))[:, None]
        g["w"] = np.einsum("antd,antz->adz", p["embed"][both], d_in)
        np.add.at(g["embed"], both, d_in @ p["w"].transpose(0, 2, 1)[:, None])
        return float((total - gold).mean()), {k: v / n for k, v in g.items()}

    def fit(self, x, y, steps, batch=64, rate=0.02, seed=0):
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(a) for k, a in self.p.items()}
        for step in range(1, steps + 1):
            pick = rng.integers(0, len(x), batch)
            _, grads = self.loss(x[pick], y[pick])
            size = np.sqrt(sum(float((a * a).sum()) for a in grads.values()))
            now = rate * (1 - 0.9 * step / steps)
            for k, a in grads.items():
                a = a * min(1, 5 / (size + 1e-9))
                m[k] = 0.9 * m[k] + 0.1 * a
                v[k] = 0.99 * v[k] + 0.01 * a * a
                self.p[k] = (self.p[k] - now * (m[k] / (1 - 0.9 ** step))
                             / (np.sqrt(v[k] / (1 - 0.99 ** step)) + 1e-7)).astype(np.float32)
        return self

    def best_path(self, em):
        """Viterbi over one stretch of any length: labels."""
        move, n = self.p["move"], len(em)
        score, came = self.p["start"] + em[0], np.zeros((n, em.shape[1]), np.int64)
        for t in range(1, n):
            all_ways = score[:, None] + move
            came[t] = all_ways.argmax(0)
            score = all_ways.max(0) + em[t]
        path = np.empty(n, np.int64)
        path[-1] = score.argmax()
        for t in range(n - 1, 0, -1):
            path[t - 1] = came[t, path[t]]
        return path
