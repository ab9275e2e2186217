"""A recurrent block labeller: a bidirectional LSTM in numpy, trained on made layouts."""

from __future__ import annotations

import random
from dataclasses import dataclass

import numpy as np

from newsward.llm.html_blocks import WIDTH, blocks, features

UNITS = 20
# Made pages to train on, rounds over them, and pages per step.
PAGES, ROUNDS, STEP_PAGES = 1500, 8, 30
SEED = 5
# Marks the main text of a made page; no real text holds it.
MAIN = "\ue000"


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Labeller:
    """Two LSTMs, one per direction, and a logistic unit on both."""

    w: list[np.ndarray]  # per direction: input weights, with bias as the last row
    u: list[np.ndarray]  # per direction: recurrent weights
    out: np.ndarray

    @staticmethod
    def new(seed: int = SEED) -> "Labeller":
        rng = np.random.default_rng(seed)
        w = [rng.standard_normal((WIDTH + 1, 4 * UNITS)).astype(np.float32) * 0.1 for _ in range(2)]
        for weights in w:
            weights[-1, UNITS : 2 * UNITS] = 1  # remember at first
        u = [rng.standard_normal((UNITS, 4 * UNITS)).astype(np.float32) * 0.1 for _ in range(2)]
        return Labeller(w, u, rng.standard_normal(2 * UNITS + 1).astype(np.float32) * 0.1)

    def weights(self) -> list[np.ndarray]:
        return [*self.w, *self.u, self.out]

    def _pass(self, x: np.ndarray, mask: np.ndarray, d: int, keep: bool):
        """States of one direction over ``x`` (pages, blocks, features)."""
        pages, steps, _ = x.shape
        gates_in = x @ self.w[d][:-1] + self.w[d][-1]
        h = c = np.zeros((pages, UNITS), np.float32)
        states, saved = np.zeros((pages, steps, UNITS), np.float32), []
        for t in range(steps) if d == 0 else range(steps - 1, -1, -1):
            z = gates_in[:, t] + h @ self.u[d]
            i, f, o = (_sigmoid(z[:, k * UNITS : (k + 1) * UNITS]) for k in range(3))
            g = np.tanh(z[:, 3 * UNITS :])
            live = mask[:, t, None]
            c_new = (f * c + i * g) * live + c * (1 - live)
            shape = np.tanh(c_new)
            h_new = o * shape * live + h * (1 - live)
            if keep:
                saved.append((t, h, c, i, f, o, g, shape, live))
            h, c = h_new, c_new
            states[:, t] = h
        return states, saved

    def probabilities(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        both = np.concatenate([self._pass(x, mask, d, False)[0] for d in (0, 1)], axis=2)
        return _sigmoid(both @ self.out[:-1] + self.out[-1])

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        passes = [self._pass(x, mask, d, True) for d in (0, 1)]
        both = np.concatenate([p[0] for p in passes], axis=2)
        wrong = (_sigmoid(both @ self.out[:-1] + self.out[-1]) - y) * mask / mask.sum()
        d_out = np.append((both * wrong[:, :, None]).sum((0, 1)), wrong.sum()).astype(np.float32)
        d_w, d_u = [], []
        for d, (_, saved) in enumerate(passes):
            from_out = wrong[:, :, None] * self.out[d * UNITS : (d + 1) * UNITS]
            gw, gu = np.zeros_like(self.w[d]), np.zeros_like(self.u[d])
            dh = dc = np.zeros((len(x), UNITS), np.float32)
            for t, h, c, i, f, o, g, shape, live in reversed(saved):
                dh = dh + from_out[:, t]
                do, ds = dh * shape * live, dh * o * live
                d_cell = dc * live + ds * (1 - shape**2)
                z = np.concatenate([d_cell * g * i * (1 - i), d_cell * c * f * (1 - f), do * o * (1 - o), d_cell * i * (1 - g**2)], axis=1)
                gw[:-1] += x[:, t].T @ z
                gw[-1] += z.sum(0)
                gu += h.T @ z
                dh = dh * (1 - live) + z @ self.u[d].T
                dc = dc * (1 - live) + d_cell * f
            d_w.append(gw)
            d_u.append(gu)
        return [*d_w, *d_u, d_out]


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(len(p) for p in pages)
    x, mask = np.zeros((len(pages), steps, WIDTH), np.float32), np.zeros((len(pages), steps), np.float32)
    for k, page in enumerate(pages):
        x[k, : len(page)], mask[k, : len(page)] = page, 1
    return x, mask


def main_blocks(model: Labeller, pages: list[np.ndarray], most_cells: int = 60_000) -> list[np.ndarray]:
    """Which blocks of each page are main text. Pages of like length are run together."""
    out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
    order = sorted((k for k in range(len(pages)) if len(pages[k])), key=lambda k: len(pages[k]))
    while order:
        take, cells = [], 0
        while order and (not take or (len(take) + 1) * len(pages[order[0]]) <= most_cells // 10):
            take.append(order.pop(0))
        x, mask = padded([pages[k] for k in take])
        probability = model.probabilities(x, mask)
        for row, k in enumerate(take):
            out[k] = probability[row, : len(pages[k])] >= 0.5
    return out


class Maker:
    """Made pages of many layouts; main text carries the mark."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def word(self) -> str:
        parts = "an be ce di er fo ga hu in ja ke lo ma ne ou pa que ré si ti un ve wa xi zu über ión eau sch".split()
        return "".join(self.r.choices(parts, k=self.r.randint(1, 4)))

    def line(self, low: int, high: int, mark: str = "") -> str:
        words = [self.word() for _ in range(self.r.randint(low, high))]
        return mark + " ".join(words).capitalize() + self.r.choice([".", ".", "", "!", "?"])

    def pick(self, *options: str) -> str:
        return self.r.choice(options)

    def around(self, names: str, inner: str, tags: str = "div div section") -> str:
        name = self.pick(*names.split())
        extra = self.pick("", "", "main-", "site-", "page-", "top-", "box-")
        attribute = self.pick("class", "class", "id")
        tag = self.pick(*tags.split())
        return f'<{tag} {attribute}="{extra}{name}">{inner}</{tag}>'

    def items(self, low: int, high: int) -> str:
        many = self.r.randint(low, high)
        if self.r.random() < 0.7:
            return "<ul>" + "".join(f'<li><a href="/{self.word()}">{self.line(1, 3)}</a></li>' for _ in range(many)) + "</ul>"
        return "".join(f'<a href="/x">{self.line(1, 3)}</a> ' for _ in range(many))

    def menu(self) -> str:
        return self.pick(f"<nav>{self.items(3, 9)}</nav>", self.around("menu navbar nav topbar breadcrumbs", self.items(3, 9)))

    def header(self) -> str:
        inner = self.pick("", f'<div class="logo">{self.line(1, 3)}</div>') + self.pick("", self.menu(), f"<p>{self.line(2, 8)}</p>")
        return self.pick(f"<header>{inner}</header>", self.around("header masthead banner", inner))

    def notice(self) -> str:
        said = self.pick("We use cookies ", "Accept ", "Please note ", "Warning ", "") + self.line(4, 25)
        return self.around("cookie cookies consent notice alert gdpr banner warning popup message", f"<p>{said}</p><button>{self.word()}</button>" if self.r.random() < 0.6 else said, "div div aside")

    def advert(self) -> str:
        said = self.pick("Advertisement ", "Sponsored ", "Buy now ", "", "") + self.line(3, 20)
        return self.around("ad ads advert advertisement sponsored sponsor promo banner adbox", self.pick(said, f"<p>{said}</p>", f'<a href="/x">{said}</a>'), "div div aside")

    def sidebar(self) -> str:
        inner = "".join(f"<h3>{self.line(1, 4)}</h3>" + self.pick(self.items(2, 6), f"<p>{self.line(4, 30)}</p>") for _ in range(self.r.randint(1, 3)))
        return self.pick(f"<aside>{inner}</aside>", self.around("sidebar widget related side aside rail recommended share social", inner, "div aside section"))

    def form(self) -> str:
        inner = f"<label>{self.line(1, 3)}</label><input name='q'><p>{self.line(3, 15)}</p><select><option>{self.word()}<option>{self.word()}</select><button>{self.pick('Subscribe', 'Send', 'Search', self.word())}</button>"
        return self.pick(f"<form action='/s'>{inner}</form>", self.around("newsletter subscribe signup login search", f"<form>{inner}</form>"))

    def comments(self) -> str:
        one = lambda: self.around("comment reply response", self.pick("", f"<b>{self.word()}</b>") + f"<p>{self.line(3, 50)}</p>", "div li article section")
        inner = f"<h3>{self.pick('Comments', self.line(1, 3))}</h3>" * self.r.randint(0, 1) + "".join(one() for _ in range(self.r.randint(1, 6)))
        return self.around("comments discussion responses replies comment-list disqus", inner, "div section section ol")

    def footer(self) -> str:
        inner = self.pick("&copy; ", "Copyright ", "") + self.line(2, 15)
        inner = self.pick(inner, f"<p>{inner}</p>", f"<p>{inner}</p>{self.items(2, 6)}")
        return self.pick(f"<footer>{inner}</footer>", f"<footer>{inner}</footer>", self.around("footer copyright legal bottom", inner))

    def body(self) -> str:
        m = MAIN
        head = self.pick("h1", "h1", "h2")
        out = [self.pick(f"<{head}>{self.line(2, 14, m)}</{head}>", f"<header><{head}>{self.line(2, 14, m)}</{head}></header>", "")]
        for _ in range(self.r.randint(1, 14)):
            kind = self.r.random()
            if kind < 0.66:
                out.append(self.pick("<p>", "<p>", '<p class="text">') + self.pick("", "", f"{m}<b>{self.line(2, 12)}<br>") + self.line(1, 120, m) + self.pick("</p>", "</p>", ""))
            elif kind < 0.76:
                out.append(f"<h2>{self.line(1, 8, m)}</h2>")
            elif kind < 0.84:
                out.append(self.pick("<ul>", "<ol>") + "".join(f"<li>{self.line(1, 20, m)}</li>" for _ in range(self.r.randint(1, 6))) + "</ul>")
            elif kind < 0.89:
                out.append(f"<blockquote>{self.line(4, 40, m)}</blockquote>")
            elif kind < 0.93:
                out.append("<table>" + "".join(f"<tr><td>{self.line(1, 4, m)}</td><td>{self.line(1, 4, m)}</td></tr>" for _ in range(self.r.randint(1, 4))) + "</table>")
            elif kind < 0.95:
                out.append(f"<div>{self.line(3, 60, m)}</div>")
            else:
                out.append(self.pick(self.advert(), self.sidebar(), self.form(), self.notice()))
        if self.r.random() < 0.15:
            out.append(self.comments())
        return "".join(out)

    def page(self) -> str:
        body = self.body()
        body = self.pick(f"<article>{body}</article>", f"<article>{body}</article>", f"<main>{body}</main>", f"<main><article>{body}</article></main>", self.around("content post entry article story text", body))
        before = [make() for make in (self.header, self.menu, self.notice, self.advert, self.sidebar, self.form) if self.r.random() < 0.4]
        after = [make() for make in (self.comments, self.sidebar, self.advert, self.form, self.notice) if self.r.random() < 0.3]
        self.r.shuffle(before)
        inner = "".join(before) + body + "".join(after)
        if self.r.random() < 0.4:
            inner = self.around("container wrapper page layout", inner)
        end = self.footer() if self.r.random() < 0.85 else ""
        title = f"<head><title>{self.line(2, 14)}</title><style>p{{}}</style></head>" if self.r.random() < 0.9 else ""
        return f"<!DOCTYPE html><html>{title}<body>{inner}{end}" + self.pick("</body></html>", "")


def made_pages(count: int, seed: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    maker, xs, ys = Maker(seed), [], []
    for _ in range(count):
        rows = blocks(maker.page())
        label = np.array([MAIN in b.text for b in rows], np.float32)
        for block in rows:
            block.text = block.text.replace(MAIN, "") or "."
        if rows:
            xs.append(features(rows))
            ys.append(label)
    return xs, ys


def trained(pages: int = PAGES, rounds: int = ROUNDS, seed: int = SEED) -> Labeller:
    """Fit a labeller by Adam steps on ``pages`` made pages (a fixed number; the
    tables hold no labels for blocks)."""
    xs, ys = made_pages(pages, seed)
    model, rng = Labeller.new(seed), np.random.default_rng(seed)
    moments = [(np.zeros_like(w), np.zeros_like(w)) for w in model.weights()]
    step = 0
    for turn in range(rounds):
        order = rng.permutation(len(xs))
        for at in range(0, len(order), STEP_PAGES):
            chosen = order[at : at + STEP_PAGES]
            x, mask = padded([xs[k] for k in chosen])
            y = np.zeros(mask.shape, np.float32)
            for row, k in enumerate(chosen):
                y[row, : len(ys[k])] = ys[k]
            step += 1
            rate = 0.02 * (1 - turn / (rounds + 1))
            for w, g, (a, b) in zip(model.weights(), model.gradients(x, mask, y), moments):
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                w -= (rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return model
