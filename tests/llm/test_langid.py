"""The convolutional network against loops and finite differences."""

import numpy as np

from skein.llm import langid


def by_hand(net, x):
    """Logits, filter by filter and place by place."""
    out = []
    for row in x.tolist():
        h = []
        for table in net.tables:
            for f in range(langid.FILTERS):
                sums = [sum(float(table[j, row[at + j], f]) for j in range(len(table))) for at in range(len(row) - len(table) + 1)]
                h.append(max(0.0, max(sums) + float(net.bias[len(h)])))
        out.append([sum(a * float(b) for a, b in zip(h, net.out[:, k])) + float(net.prior[k]) for k in range(len(net.labels))])
    return np.array(out)


def made(double=False):
    net, rng = langid.Net(["aa", "bb", "cc"]), np.random.default_rng(2)
    net.bias += rng.normal(0, 0.1, net.bias.shape).astype(np.float32)
    net.prior += rng.normal(0, 0.1, 3).astype(np.float32)
    if double:
        net.tables = [t.astype(np.float64) for t in net.tables]
        net.bias, net.out, net.prior = (p.astype(np.float64) for p in (net.bias, net.out, net.prior))
    return net, rng.integers(97, 105, (6, 20)).astype(np.uint8), rng.integers(0, 3, 6)


def test_logits_are_those_of_a_loop():
    net, x, _ = made()
    assert np.allclose(net.logits(x), by_hand(net, x), atol=1e-5)


def test_gradients_are_finite_differences():
    net, x, y = made(double=True)

    def loss():
        return -np.log(langid.softmax(net.logits(x))[np.arange(len(x)), y]).mean()

    told, rng, seen = net.gradients(x, y), np.random.default_rng(4), 0
    for p, g in zip(net.params(), told):
        places = np.argwhere(g != 0)
        for at in map(tuple, places[rng.permutation(len(places))[:25]]):
            old, h = p[at], 1e-6
            p[at] = old + h
            up = loss()
            p[at] = old - h
            down = loss()
            p[at] = old
            seen += 1
            assert abs((up - down) / (2 * h) - g[at]) < 1e-6
    assert seen > 100


def test_windows_hold_every_byte_once():
    texts = [b"", b"ABC", bytes(range(33, 127)) * 5, b"x" * langid.WINDOW, b"y" * (langid.WINDOW + 1)]
    data, at = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    x, n = langid.windows(data, at)
    assert n.tolist() == [0, 1, 4, 1, 2]
    ends = np.cumsum(n)
    for t, a, b in zip(texts, ends - n, ends):
        assert x[a:b].tobytes().rstrip(b"\0") == t.lower()


def test_a_text_is_judged_by_all_its_windows():
    """Each text's log-probabilities, window by window, weighed by their bytes."""
    net, rng = made()[0], np.random.default_rng(9)
    texts = ["".join(chr(97 + k) for k in rng.integers(0, 8, n)) for n in (1, 60, 128, 129, 700)]
    data = [t.encode() for t in texts]
    langs, scores = langid.predicted(net, np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)]), [type("T", (), {"as_py": lambda self, t=t: t})() for t in texts])
    for t, lang, score in zip(data, langs, scores):
        total = np.zeros(3)
        for k in range(0, len(t), langid.WINDOW):
            part = t[k : k + langid.WINDOW]
            one = np.frombuffer(part.ljust(langid.WINDOW, b"\0"), np.uint8)[None]
            total += len(part) * np.log(langid.softmax(by_hand(net, one))[0] + 1e-9)
        p = langid.softmax(total / len(t))
        assert lang == net.labels[int(p.argmax())] and abs(score - p.max()) < 1e-4
