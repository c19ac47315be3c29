"""Plain Python versions of the operators' contracts, without Spark and as literal as can be."""

from __future__ import annotations

import hashlib
import re
import struct
from collections import Counter
from html import unescape
from html.parser import HTMLParser
from math import floor

import public_tokenizers
import regex
import tiktoken

from graphloom.llm.bpe import read_ranks

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def encoder():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})


def sha(data):
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


def histogram(lengths):
    out = {}
    for n, c in Counter(lengths).items():
        over = [x for x in lengths if x >= n]
        out[n] = (c, len(over), sum(over), sum(x <= n for x in lengths), len(lengths), sum(lengths), sum(min(x, n) for x in lengths))
    return out


def codes(docs):
    enc = encoder()
    out = {}
    for i, text in docs:
        ids = enc.encode_ordinary(text or "")
        out[i] = (len(ids), sha(struct.pack(f"<{len(ids)}I", *ids)), sha(text or ""))
    return out


def nearest(rows, k=5):
    whole = {i: [floor(256.0 * float(x)) for x in v] for i, v in rows}
    out = set()
    for q in whole:
        if q % 50 == 0:
            scored = sorted((-sum(a * b for a, b in zip(whole[q], v, strict=True)), i) for i, v in whole.items() if i != q)
            out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])}
    return out


def shingle_set(text, n):
    w = words(lower(text))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) or frozenset([tuple(w)])


def near_duplicates(docs, n=2, hundredths=80):
    sets = {i: shingle_set(t, n) for i, t in docs}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            small, large = sorted((len(sets[a]), len(sets[b])))
            if small and 100 * small >= hundredths * large and 100 * len(sets[a] & sets[b]) >= hundredths * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {(i, len(sets[i]), find(i), find(i) == i) for i in ids}


def level_targets(totals, weights=(1, 2, 3), most=3):
    """totals: source -> words. Sources above their most are fixed one by one, and the rest shared anew."""
    names = sorted(totals, key=lambda s: (s is None, [ord(c) for c in s or ""]))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    fixed, everything = {}, sum(totals.values())
    while True:
        free = [s for s in names if s not in fixed]
        if not free:
            return fixed
        left = everything - sum(fixed.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        above = [s for s in free if share[s] > most * totals[s]]
        if not above:
            return fixed | share
        fixed |= {s: most * totals[s] for s in above}


def rule_counts(text):
    text = text or ""
    w = words(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in range(3)}
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), failed


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def pii(text):
    text = text or ""
    digits = lambda s: re.sub("[^0-9]", "", s)
    found = [("email", m) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [("ip", m) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    found += [("card", m) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 13 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    found += [("phone", m) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(digits(m[0])) <= 15]
    return [(k, m.start(), m.end()) for k, m in found]


def secrets(text):
    text = text or ""
    assign = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    found = [("assign", m) for m in re.finditer(assign, text) if len(m[2]) >= 6]
    found += [("access", m) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [("hex", m) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    order = {"assign": 0, "access": 1, "hex": 2}
    return sorted(((k, m.start(), m.end()) for k, m in found), key=lambda s: (s[1], order[s[0]]))


def written(found):
    return ",".join(f"{k}:{a}:{z}" for k, a, z in found)


def without_repeats(docs, window=50):
    first, split = {}, {i: words(t) for i, t in docs}
    for i, w in split.items():
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            first[key] = min(first.get(key, i), i)
    out = {}
    for i, w in split.items():
        gone = set()
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < i:
                gone |= set(range(k, k + window))
        out[i] = (len(w), len(gone), sha(" ".join(x for k, x in enumerate(w) if k not in gone)))
    return out


def pareto_mix(rows, targets, most=3, steps=16, half=200):
    """rows: (key, source, words, u, tie). How often each is taken: copies, then the lowest ranks up to the open words."""
    from collections import defaultdict
    from math import log2

    def rounded(x):  # half away from zero
        return floor(abs(x) + 0.5) * (1 if x >= 0 else -1)

    of = defaultdict(list)
    for row in rows:
        of[row[1]].append(row)
    out = {}
    for source, members in of.items():
        weight = {r[0]: 2.0 ** (rounded(log2(0.5 + r[2] / (r[2] + half)) * steps) / steps) for r in members}
        capped: set = set()
        while True:  # documents above most are fixed, and the scale of the others found anew
            rest = sum(r[2] * weight[r[0]] for r in members if r[0] not in capped)
            left = targets[source] - most * sum(r[2] for r in members if r[0] in capped)
            scale = left / rest if rest else float("inf")
            above = {r[0] for r in members if r[0] not in capped and scale * weight[r[0]] > most * (1 + 1e-12)}
            if not above:
                break
            capped |= above
        expected = {r[0]: (most if r[0] in capped else min(most, scale * weight[r[0]])) if targets[source] > 0 else 0 for r in members}
        copies = {k: floor(m + 1e-9) for k, m in expected.items()}
        chance = {k: m - copies[k] if m - copies[k] > 1e-9 else 0 for k, m in expected.items()}
        opened = sum(r[2] * chance[r[0]] for r in members)
        ranked = sorted(((r[3] / (1 - r[3])) / (chance[r[0]] / (1 - chance[r[0]])), r[4], r[0], r[2]) for r in members if chance[r[0]])
        met = 0
        for _, _, key, size in ranked:
            met += size
            if met - size / 2 <= opened and opened:
                copies[key] += 1
        out |= copies
    return out


class _Dom(HTMLParser):
    """A tree of (tag, classes, children), with text as strings; a block element ends an open paragraph."""

    BLOCKS = frozenset("address article aside blockquote body div dl dt dd fieldset figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main nav ol p pre section table tr ul".split())

    def __init__(self):
        super().__init__(convert_charrefs=False)
        self.root = ("", [], [])
        self.path = [self.root]

    def handle_starttag(self, tag, attrs):
        if tag in self.BLOCKS and any(n[0] == "p" for n in self.path):
            self.handle_endtag("p")
        node = (tag, (dict(attrs).get("class") or "").split(), [])
        self.path[-1][2].append(node)
        if tag not in ("br", "meta", "img", "link", "input", "hr"):
            self.path.append(node)

    def handle_endtag(self, tag):
        if any(n[0] == tag for n in self.path):
            while self.path.pop()[0] != tag:
                pass

    def handle_data(self, data):
        self.path[-1][2].append(data)

    def handle_entityref(self, name):
        self.path[-1][2].append(unescape(f"&{name};"))

    def handle_charref(self, name):
        self.path[-1][2].append(unescape(f"&#{name};"))


def article_text(page):
    """All blocks of the page's article elements; nothing in them is hidden and no length counts."""
    dom = _Dom()
    dom.feed(page)
    dom.close()
    out = [""]

    def walk(node, inside):
        for child in node[2]:
            if isinstance(child, str):
                out[-1] += child if inside else ""
            elif child[0] not in ("script", "style"):
                block = child[0] in dom.BLOCKS
                out.extend([""] * block)
                out[-1] += " " * (child[0] == "br")
                walk(child, inside or child[0] == "article")
                out.extend([""] * block)

    walk(dom.root, False)
    return "\n".join(t for t in (" ".join(x.split()) for x in out) if t)


def main_text(page, width=3, surge=86, share=0.2):
    """Line-block distribution over a parsed tree, for pages whose other parts are nav, footer, header, aside, form and
    the class ``ad``, and that have no links in the text."""
    dom = _Dom()
    dom.feed(page)
    dom.close()
    lines, now = [], []

    def flush(hidden, place):
        text = " ".join("".join(now).split())
        if text:
            lines.append(("" if hidden else text, 0 if hidden else len(text), place))
        now.clear()

    def walk(node, hidden, place):
        for child in node[2]:
            if isinstance(child, str):
                now.append(child)
            elif child[0] in ("script", "style", "title"):
                continue
            elif child[0] == "br":
                now.append(" ")
            else:
                inner = hidden or child[0] in ("nav", "footer", "aside", "form", "head") or "ad" in child[1] or child[0] == "header" and not place
                own = place or (id(child) if child[0] in ("article", "main") and not inner else 0)
                if child[0] in _Dom.BLOCKS:
                    flush(hidden, place)
                walk(child, inner, own)
                if child[0] in _Dom.BLOCKS:
                    flush(inner, own)

    walk(dom.root, False, 0)
    flush(False, 0)
    parts: list = []
    for line in lines:
        if not parts or parts[-1][-1][2] != line[2]:
            parts.append([])
        parts[-1].append(line)
    window = lambda part, i: sum(n for _, n, _ in part[i : i + width])
    largest = max((window(p, i) for p in parts for i in range(len(p))), default=0)
    threshold = min(surge, share * largest)
    out = []
    for part in parts:
        if not largest or max(window(part, i) for i in range(len(part))) < threshold:
            continue
        runs, i = [], 0
        while i < len(part):
            if not part[i][1]:
                i += 1
                continue
            start = i
            while i < len(part) and window(part, i):  # the dive: width lines without length
                i += 1
            runs.append(part[start:i])
        for run in runs:
            if part[0][2] or max(window(run, i) for i in range(len(run))) >= threshold:
                out += [t for t, _, _ in run if t]
    return "\n".join(out)


TERM = regex.compile(r"(?<!\p{L})\p{L}[\p{L}'-]{2,}+")


def own_terms(texts, near=100, disclose=0.8):
    """For each text, the words near an entity that no other text holds whose PMI comes close to the entity's content."""
    from math import log2

    total = len(texts)
    n_t, n_e, holds = Counter(), Counter(), {}
    for text in texts:
        n_t.update({m[0].lower() for m in TERM.finditer(text)})
    for text in set(texts):
        bare = list(text)
        found = pii(text)
        for _, a, z in found:
            bare[a:z] = " " * (z - a)
        bare = "".join(bare)
        terms = {m[0].lower() for m in TERM.finditer(bare)}
        raw = {m[0].lower() for m in TERM.finditer(text)}
        for t in raw ^ terms:
            n_t[t] += texts.count(text) * (1 if t in terms else -1)
        holds[text] = {}
        for kind, a, z in found:
            around = bare[max(a - near, 0) : a] + " " + bare[z : z + near]
            holds[text].setdefault(f"{kind}:{text[a:z].lower()}", set()).update({m[0].lower() for m in TERM.finditer(around)} & terms)
    for text in texts:
        n_e.update(holds[text].keys())
    several = {e for e, _ in Counter(e for t in set(texts) for e in holds[t]).items() if sum(e in holds[t] for t in set(texts)) > 1}
    out = {}
    for text, entities in holds.items():
        words = set()
        for e, terms in entities.items():
            content = log2(total / n_e[e])
            if e not in several and content > 0:
                words |= {t for t in terms if log2(total * n_e[e] / (n_e[e] * n_t[t])) >= disclose * content}
        out[text] = words
    return out
