"""Plain Python versions that operators are held against."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

LOWER = {k: k + 32 for k in range(65, 91)}


def by_key(df, key="doc_id"):
    return sorted(df.collect(), key=lambda r: (r[key] is None, r[key] or 0, repr(r)))


def plain_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def plain_set(text):
    w = plain_words(text)
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def tiktoken_counts(path, texts):
    """Token counts by the library itself."""
    import base64

    import public_tokenizers
    import tiktoken

    ranks = {}
    for line in open(path, "rb"):
        token, rank = line.split()
        ranks[base64.b64decode(token)] = int(rank)
    model = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return [len(model.encode_ordinary(t)) for t in texts]


def luhn(digits):
    """Whether a number's check digit is right."""
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


#: What the documents hold of personal data, as plain patterns: kind, pattern.
PERSONAL = re.compile(
    r"(?P<email>[A-Za-z0-9._-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)|(?P<phone>\+1 \(\d{3}\) \d{3}-\d{4})|(?P<card>(?<![\dA-Za-z])[2-6]\d{15}(?![\dA-Za-z]))"
    r"|(?P<ip>(?<![\d.A-Za-z])\d{1,3}(?:\.\d{1,3}){3}(?![\d.]))|(?P<secret>(?<=token = \")[0-9a-f]{40})"
)
SHAPES = {"email": r"[^\s@]+@[a-z]+\.example\.com", "phone": r"\+1 \([01]\d\d\) \d{3}-\d{4}", "card": r"\d{16}", "ip": r"2[45]\d(?:\.\d{1,3}){3}", "secret": r"[0-9a-f]{40}"}


def check_surrogates(pairs):
    """Texts and their replacements: all but the entities is as it was, each has a surrogate of its shape, equal ones equal ones, different ones different ones, none one of the corpus."""
    made = {}
    for before, after in pairs:
        parts, kinds, at = [], [], 0
        for m in PERSONAL.finditer(before or ""):
            if m.lastgroup != "card" or luhn(m[0]):
                parts += [re.escape(before[at : m.start()]), f"({SHAPES[m.lastgroup]})"]
                kinds.append((m.lastgroup, m[0].lower()))
                at = m.end()
        if not kinds:
            assert before == after
            continue
        found = re.fullmatch("".join(parts) + re.escape(before[at:]), after)
        assert found, (before[:200], after[:200])
        for kind, new in zip(kinds, found.groups(), strict=True):
            assert made.setdefault(kind, new.lower()) == new.lower()
            assert kind[0] != "card" or luhn(new)
    assert len({(k[0], v) for k, v in made.items()}) == len(made) and not {v for v in made.values()} & {v for _, v in made}
    return Counter(k for k, _ in made)


def windows_like(words, own, least=0.8):
    """Whether some window of an item's size has a weighted 5-word similarity to it of ``least`` or more."""
    width = min(5, len(own))
    grams = lambda x: Counter(tuple(x[k : k + width]) for k in range(len(x) - width + 1))
    want = grams(own)
    if not own or not want.keys() & grams(words).keys():
        return False
    for start in range(max(1, len(words) - len(own) + 1)):
        got = grams(words[start : start + len(own)])
        both = sum((want & got).values())
        if both >= least * (sum(want.values()) + sum(got.values()) - both):
            return True
    return False


def components_of(rows, links=None):
    """For (key, set) rows the least key of each row's component: null for a null key, links by similarity unless given by place."""
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    if links is None:
        links, holders = [], defaultdict(list)
        for k, (_, s) in enumerate(rows):
            for x in s:
                holders[x].append(k)
        for k, (i, s) in enumerate(rows):
            if i is not None:
                for j, n in Counter(j for x in s for j in holders[x] if j > k and rows[j][0] is not None).items():
                    if 100 * n >= 80 * (len(s) + len(rows[j][1]) - n):
                        links.append((k, j))
    for a, b in links:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return [None if i is None else least[find(k)] for k, (i, _) in enumerate(rows)]
