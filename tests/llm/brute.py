"""Plain one-machine versions of the operators' contracts."""

import base64
import collections
import hashlib
import math
import re
import zlib

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def substring(docs, width=35):
    """docs: (id, text) rows. (id, n_words, n_removed, kept text) rows in their order."""
    found = [WORD.findall(t or "") for _, t in docs]
    seen = collections.Counter(tuple(w[i : i + width]) for w in found for i in range(len(w) - width + 1))
    out = []
    for (d, _), w in zip(docs, found):
        gone = [False] * len(w)
        for i in range(len(w) - width + 1):
            if seen[tuple(w[i : i + width])] > 1:
                gone[i : i + width] = [True] * width
        out.append((d, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return out


def base_rules(text):
    text = text or ""
    words = WORD.findall(text)
    windows = collections.Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    again = [False] * len(words)
    for i in range(len(words) - 4):
        if windows[tuple(words[i : i + 5])] > 1:
            again[i : i + 5] = [True] * 5
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    failed = len(words) < 10 or 100 * sum(again) > 20 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, sum(again), failed


def fingerprint(text):
    import xxhash

    raw = bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode())
    words = re.findall(rb"[^\x20\x09-\x0D]+", raw)
    shingles = [b" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def classes(fps, bits=4):
    """fps: {id: fingerprint}. {id: smallest id reachable}."""
    root = {d: d for d in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(fps)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if (fps[a] ^ fps[b]).bit_count() <= bits:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: find(d) for d in ids}


def sha1_base32(payload):
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def crc(ids):
    return zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))


def best_fit_decreasing(lengths, window):
    """Room left in each window."""
    room = []
    for n in sorted(lengths, reverse=True):
        fits = [r for r in room if r >= n]
        if fits:
            room.remove(min(fits))
            room.append(min(fits) - n)
        else:
            room.append(window - n)
    return sorted(room)


def phrases(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)
    places, labels = [], set()
    for phrase, label in (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")):
        own = phrase.split()
        for i in range(len(words) - len(own) + 1):
            if words[i : i + len(own)] == own:
                places.append(i)
                labels.add(label)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


class LogRatio:
    """The log-likelihood ratio of hashed words and pairs, with the hash written out on whole numbers.

    A word of up to 64 bytes is read in 8-byte numbers, each met with the hash so far, multiplied and mixed; a longer one is
    hashed by XXH64 and mixed. A pair is a sum over its words' hashes with a factor for each place, mixed.
    """

    MASK = (1 << 64) - 1

    def __init__(self, factors, pair_factors, buckets, smoothing):
        self.factors, self.pair_factors, self.buckets, self.smoothing = [int(x) for x in factors], [int(x) for x in pair_factors], buckets, smoothing

    def mix(self, x):
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ x >> shift) * factor & self.MASK
        return x ^ x >> 31

    def word(self, raw):
        import xxhash

        if len(raw) > 64:
            return self.mix(xxhash.xxh64_intdigest(raw, 0))
        h = len(raw) * self.factors[8] & self.MASK
        for k in range(0, len(raw), 8):
            h = self.mix((h ^ int.from_bytes(raw[k : k + 8], "little")) * self.factors[k // 8] & self.MASK)
        return h

    def grams(self, text):
        found = [self.word(w.encode()) for w in WORD.findall(text or "")]
        x, y = self.pair_factors
        pairs = [self.mix(a * x + b * y & self.MASK) for a, b in zip(found, found[1:])]
        return [h * self.buckets >> 64 for h in found + pairs]

    def fit(self, rows, good):
        raw, target = collections.Counter(), collections.Counter()
        for d, t in rows:
            own = self.grams(t)
            raw.update(own)
            if d in good:
                target.update(own)
        share = lambda c, k: math.log((c[k] + self.smoothing) / (sum(c.values()) + self.smoothing * self.buckets))
        self.raw, self.target = raw, target
        self.weight = {k: share(target, k) - share(raw, k) for k in raw} if target else dict.fromkeys(raw, 0.0)

    def score(self, text):
        own = self.grams(text)
        return sum(self.weight[k] for k in own) / max(1, len(own))

    def score_left_out(self, text):
        """The score with this text taken out of the target."""
        own = self.grams(text)
        rest = self.target - collections.Counter(own)
        share = lambda c, k: math.log((c[k] + self.smoothing) / (sum(c.values()) + self.smoothing * self.buckets))
        return sum(n * (share(rest, k) - share(self.raw, k)) for k, n in collections.Counter(own).items()) / max(1, len(own))


def cheapest_thresholds(good, bad, weight, step, low):
    """Of the multiples of `step` from `low` to its opposite, those that cost least; rejecting a good score costs `weight` times as much as keeping a bad one."""
    cost = {}
    for k in range(int(-2 * low / step) + 1):
        t = low + k * step
        cost[t] = weight * sum(g < t for g in good) / len(good) + sum(b >= t for b in bad) / len(bad)
    least = min(cost.values())
    return [t for t, c in cost.items() if c <= least + 1e-9]
