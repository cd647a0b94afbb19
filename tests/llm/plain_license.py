"""Licence scans in plain Python, without gate: every paragraph of a text is classified. Written apart from the operator;
only the templates, the trained weights and the limits are the operator's."""

import math
import re

from mapstone.llm import license_scan

SIGN = r"(?://+!?|/\*+|\*+/|\*+|#+|--+|;+|%+|<!--+|>+|\|+|\(\*|\{-|\.\.)"


def bare(line):
    line = re.sub(r"^[ \t\r]*" + SIGN + r"(?=[ \t\r]|$)|^[ \t\r]*(?://+!?|/\*+|#+|--+|;+)", "", line, count=1)
    return re.sub(r"[ \t\r]*(?:\*+/|--+>|\*\)|-\}|\*+|#+)?[ \t\r]*$", "", line).lstrip(" \t\r")


def paragraphs(text):
    """(first line, last line, text) of every line, and of every sentence over several lines."""
    lines = text.split("\n")
    out = [(k, k, x) for k, x in enumerate(lines)]
    at, run = [], []
    for k, x in [*((k, bare(x)) for k, x in enumerate(lines)), (None, "")]:
        if x:
            at.append(k)
            run.append(x)
            continue
        words = [(k, w) for k, x in zip(at, run, strict=True) for w in re.split(r"[ \t\r]+", x) if w]
        sentence = []
        for i, (k, w) in enumerate(words):
            sentence.append((k, w))
            ends = w[-1] in ".!?" and i + 1 < len(words) and re.match(r"[\"'(\[]?[A-Z]", words[i + 1][1])
            if ends or i + 1 == len(words):
                if sentence[0][0] != sentence[-1][0]:
                    out.append((sentence[0][0], sentence[-1][0], " ".join(w for _, w in sentence)))
                sentence = []
        at, run = [], []
    return out


def tokens(text):
    return [w for w in (x.strip(".") for x in re.findall(r"[a-z0-9.]+", text.lower())) if w]


def pairs(words):
    return {f"{a} {b}" for a, b in zip(words, words[1:], strict=False)} or set(words)


def scan(text):
    model = license_scan.trained()
    templates = [(f, pairs(tokens(t))) for f, ts in license_scan.TEMPLATES.items() for t in ts]
    rows = []
    for first, last, part in paragraphs(text or ""):
        words = tokens(part)
        grams = {" ".join(words[i : i + k]) for k in (1, 2, 3) for i in range(len(words) - k + 1)} & model["weights"].keys()
        family, sure, p, over = license_scan.UNKNOWN, False, 0.0, 0.0
        if grams:
            z = [round(b + sum(model["weights"][g][k] for g in grams), 6) for k, b in enumerate(model["bias"])]
            whole = sum(math.exp(x - max(z)) for x in z)
            chance = {f: round(math.exp(x - max(z)) / whole, 6) for f, x in zip(model["families"], z, strict=True)}
            has = pairs(words) if len(words) > 1 else set(words)
            share = lambda q: len(has & q) / len(q)
            best = (False, 0.0, 0.0, "")
            for f, q in templates:
                if chance[f] >= license_scan.PLAUSIBLE:
                    rivals = [share(r) for g, r in templates if g != f and len(q & r) >= license_scan.SIBLING * min(len(q), len(r))]
                    best = max(best, (share(q) >= license_scan.CONFIRM and share(q) >= max(rivals, default=0), chance[f], share(q), f))
            sure = chance[license_scan.UNKNOWN] <= 1 - license_scan.CERTAIN and best[0]
            over, family, p = best[2], best[3] if sure else license_scan.UNKNOWN, best[1] if sure else max(chance.values())
        if sure or re.search(license_scan.CUES, part, re.I):
            rows.append((sure, round(p, 6), -first, -last, family, round(over, 6)))
    n, gone = len(rows), set()
    for w in rows:
        if w[0] and w[2] != w[3]:
            inside = [r for r in rows if r[0] and r[2] == r[3] and w[3] <= r[2] <= w[2]]
            if inside and max(r[5] for r in inside) >= w[5]:
                gone.add(w)
            else:
                gone.update(inside)
    left = [r for r in rows if r not in gone]
    return {
        "family": max(left)[4] if left else "none",
        "n_notices": sum(r[0] for r in left),
        "n_candidates": n,
        "families": ",".join(sorted({r[4] for r in left if r[0]})),
    }
