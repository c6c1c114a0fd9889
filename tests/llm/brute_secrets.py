"""Plain Python version of the secret scan."""

import hashlib
import math
import re
from collections import Counter

from millrace.llm import secrets as S

ASSIGN = re.compile("(?ai:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS, HEX = re.compile("AKIA[A-Z0-9]+"), re.compile("[0-9a-f]+")
RUN = re.compile("[A-Za-z0-9+/_=-]+")
# ``(?i)`` ranges over ASCII only, as in the patterns' own engine
ALLOWED = [re.compile(p.replace("(?i)", "(?ia:") + ")" if p.startswith("(?i)") else p) for p in S.ALLOWED]


def entropy(run, w):
    best = 0
    for i in range(len(run) - w + 1):
        s = sum(S.xlogx(n) for n in Counter(run[i : i + w]).values())
        best = max(best, math.floor((S.xlogx(w) - s) / w))
    return best


def allowed(run):
    if any(a.search(run) for a in ALLOWED):
        return True
    parts = [p for p in re.split("[-_/=]+", run) if p]
    return all(p.isalpha() or (p.isdigit() and len(p) <= 8) or (i == 0 and re.fullmatch("[A-Za-z]+[0-9]{1,8}", p)) for i, p in enumerate(parts))


def scan(text):
    text = text or ""
    base = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    masked = list(text)
    for a, _, b in base:
        masked[a:b] = " " * (b - a)
    base += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 18]
    base += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if len(m[0]) >= 16]
    base.sort()
    more = []
    for m in RUN.finditer("".join(masked)):
        run = m[0]
        if len(run) < 20 or not re.search("[0-9]", run) or not re.search("[A-Za-z]", run) or allowed(run):
            continue
        if HEX.fullmatch(run) or ACCESS.fullmatch(run):
            continue
        least = next(t for _, p, t in S.CLASSES if re.search(p, run))
        if entropy(run, S.WINDOW) >= least:
            more.append((m.start(), 3, m.end()))
    names = ("assign", "access", "hex", "entropy")
    say = lambda xs: ",".join(f"{names[k]}:{a}:{b}" for a, k, b in sorted(xs))
    count = lambda k: sum(x[1] == k for x in base)
    return count(0), count(1), count(2), hashlib.sha256(say(base).encode()).hexdigest(), say(base + more), len(more)
