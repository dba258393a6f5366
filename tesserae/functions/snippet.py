"""Snippets: a window of at most twelve tokens of a line, with the phrases of the query marked.

The window is chosen among those around each phrase instance and those that start with its
sentence: a window scores 1000 for each distinct phrase and 1 for each further instance inside,
and a bonus for starting with the line or with a sentence.  An instance's window is moved back so
that its instances stand in the middle, as far as the line's ends allow (not at all if the last one
sticks out).  Marks of instances that overlap become one; one
that starts before the window is left out, one that the window's end cuts is marked as far as it
goes.
"""

from __future__ import annotations

from tesserae.functions.text import spans
from tesserae.plans.match import And, Near, Node, Not, Phrase, leaves

OPEN, CLOSE, CUT, TOKENS = ">>>", "<<<", "...", 12
#: The bonus of a window that starts with the line, or with another sentence.
OPENING, SENTENCE = 120, 100


def phrase_starts(terms: list[str], p: Phrase) -> list[int]:
    """The positions at which a phrase starts."""
    size = len(p.terms)
    out = []
    for i in range(len(terms) - size + 1 if size else 0):
        last = terms[i + size - 1]
        if tuple(terms[i : i + size - 1]) == p.terms[:-1] and (last.startswith(p.terms[-1]) if p.prefix else last == p.terms[-1]) and (i == 0 or not p.initial):
            out.append(i)
    return out


def leaf_starts(terms: list[str], leaf: Near) -> list[list[int]]:
    """The starts of each phrase of a leaf that count: in NEAR, those in a window with all others."""
    own = [[] if leaf.dead else phrase_starts(terms, p) for p in leaf.phrases]
    if len(own) == 1:
        return own
    sizes = [len(p.terms) for p in leaf.phrases]
    kept: list[set[int]] = [set() for _ in own]
    for last in {x for starts in own for x in starts}:
        low = last - leaf.distance
        inside = [[x for x in starts if x <= last and x + n >= low] for starts, n in zip(own, sizes, strict=True)]
        if all(inside):
            for k, xs in zip(kept, inside, strict=True):
                k.update(xs)
    return [sorted(k) for k in kept]


def instances(terms: list[str], node: Node) -> list[tuple[int, int, int]]:
    """(start, size, phrase number) of the instances that count, from left to right: those of
    phrases whose every enclosing AND and NOT holds in the line."""
    every = [leaf_starts(terms, leaf) for leaf in leaves(node)]
    leaf_at = phrase_at = 0

    def walk(x: Node, counts: bool) -> tuple[bool, list[tuple[int, int, int]]]:
        """Whether a node holds, and the instances below it that count if all above it hold."""
        nonlocal leaf_at, phrase_at
        if isinstance(x, Near):
            starts = every[leaf_at]
            leaf_at += 1
            found = []
            for p, own in zip(x.phrases, starts, strict=True):
                found += [(i, len(p.terms), phrase_at) for i in own]
                phrase_at += 1
            holds = all(starts)
            return holds, found if holds and counts else []
        if isinstance(x, Not):
            left, found = walk(x.left, counts)
            right, _ = walk(x.right, False)
            return left and not right, found if left and not right else []
        parts = [walk(p, counts) for p in x.parts]
        holds = all(h for h, _ in parts) if isinstance(x, And) else any(h for h, _ in parts)
        return holds, [f for _, fs in parts for f in fs] if holds else []

    return sorted(walk(node, True)[1])


def window_score(found: list[tuple[int, int, int]], start: int, size: int) -> tuple[int, int, int]:
    """(score, first token, behind the last token) of the instances that start inside a window."""
    seen: set[int] = set()
    score, first, last = 0, -1, 0
    for i, n, number in found:
        if start <= i < start + size:
            score += 1 if number in seen else 1000
            seen.add(number)
            first = i if first < 0 else first
            last = i + n
    return score, first, last


def sentence_starts(content: str, toks: list[tuple[str, int, int]]) -> list[int]:
    """Tokens that open the line or stand behind a full stop or colon and white space."""
    out = []
    for i, (_, at, _) in enumerate(toks):
        before = content[:at].rstrip(" \t\n\r") if i else ""
        if not i or (len(before) < at and before[-1:] in (".", ":")):
            out.append(i)
    return out


def choose(found: list[tuple[int, int, int]], starts: list[int], total: int, size: int) -> int:
    """The first token of the best window; of equal ones the one found first."""
    best, best_start = 0, 0
    for i, _, _ in found:
        score, first, last = window_score(found, i, size)
        if score > best:
            best, best_start = score, max(0, min(first - max(0, size - (last - first)) // 2, total - size))
        opening = [s for s in starts if s <= i][-1:]
        if total > size and opening and opening[0] < i:
            score = window_score(found, opening[0], size)[0] + (OPENING if opening[0] == 0 else SENTENCE)
            if score > best:
                best, best_start = score, opening[0]
    return best_start


def snippet(content: str, node: Node, size: int = TOKENS) -> str:
    toks = spans(content)
    found = instances([t for t, _, _ in toks], node)
    start = choose(found, sentence_starts(content, toks), len(toks), size)
    stop = min(len(toks), start + size)
    groups: list[list[int]] = []
    for i, n, _ in found:
        if groups and i < groups[-1][1]:
            groups[-1][1] = max(groups[-1][1], i + n)
        else:
            groups.append([i, i + n])
    marks = [(a, min(b, stop)) for a, b in groups if start <= a < stop]
    out = [CUT if start > 0 else ""]
    at = toks[start][1] if start > 0 else 0
    for a, b in marks:
        out += [content[at : toks[a][1]], OPEN, content[toks[a][1] : toks[b - 1][2]], CLOSE]
        at = toks[b - 1][2]
    end = toks[stop - 1][2] if stop < len(toks) else len(content)
    out += [content[at:end], CUT if stop < len(toks) else ""]
    return "".join(out)


