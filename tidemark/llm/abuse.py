"""Abusive, hateful or sexually explicit passages: a bidirectional GRU with attention pooling.

The network reads windows of words.  A word enters as its own vector (when it stood in the
training texts) plus the mean of its character trigrams' vectors, so odd spellings and unseen
words still mean something.  Training and scoring are numpy only; every overlapping window of
every document is scored, and a document's score is that of its worst window.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Windows overlap by 16 words, so every passage of up to 16 words stands whole in one.
WINDOW, STRIDE = 32, 16

# Seed material of common coarse language; no sentence of it is taken from texts to be scored.
_INSULTS = "moron idiot bastard asshole prick scum trash loser cretin dirtbag piece_of_shit son_of_a_bitch motherfucker dickhead wanker dumbass douchebag retard whore slut cunt parasite vermin imbecile clown".split()
_GROUPS = "women gays foreigners immigrants refugees muslims jews blacks gypsies asians lesbians christians".split()
_SEEDS = {
    1: [
        "i hope you get cancer and die", "i will come to your house and slit your throat", "nobody likes you, you fat ugly {i}", "go fuck yourself", "burn in hell you {i}", "i swear i will strangle that {i}", "bloody {i}s the lot of them", "you absolute {i}, go back to school", "your mother is a whore", "shut up you fat pig", "you worthless {i}, nobody wants you here", "du widerlicher drecksack", "halts maul du vollidiot", "ich hoffe du verreckst", "ihr verdammten idioten", "man sollte dich erschießen du penner", "leck mich am arsch du trottel", "dumme kuh", "ihr blöden wichser und dreckskerle", "cállate la boca estúpido", "ojalá te mueras maldito", "eres una puta basura", "maldito imbécil de mierda", "lárgate inútil asqueroso", "panda de idiotas y ladrones", "crève sale ordure", "tu es un gros débile", "nique ta mère", "bande d abrutis finis", "pauvre type tu mérites de crever", "ta gueule imbécile", "sales cons et minables",
        "shut the fuck up you stupid {i}", "go to hell you filthy {i}", "you {i}, i hope you die", "fuck off you {i}",
        "i will find you and kill you", "i will beat you up you {i}", "someone should hang that worthless {i}", "kill yourself you useless {i}", "what a dumb {i}, screw you all",
        "drop dead you {i}",
        "du verdammter hurensohn halt die fresse", "verpiss dich du arschloch", "fick dich du dreckige sau", "du bist ein dummes stück scheiße", "ich bringe dich um du schwein",
        "vete a la mierda cabrón", "eres un gilipollas de mierda", "que te jodan hijo de puta", "sois unos cabrones y unos inútiles", "te voy a matar cabrón",
        "ferme ta gueule espèce de connard", "va te faire foutre salaud", "espèce de salope de merde", "bande de cons et de merdeux", "je vais te tuer enculé", "sales fils de pute",
    ],
    2: [
        "{g} should go back where they came from", "{g} are criminals and rapists, all of them", "burn down the houses of the {g}", "never hire {g}, they are lazy and they steal", "the {g} must be wiped out", "no {g} allowed here, they stink", "{g} are too dumb to run a company", "{g} are a cancer on this country", "a brain like that belongs in a kitchen, {g} cannot count", "{g} sind der abschaum der menschheit", "{g} gehören ins lager", "{g} haben hier nichts zu suchen, sie sind dumm und faul", "{g} sind wie ratten", "{g} son inferiores y sucios", "fuera los {g} de aquí", "los {g} huelen mal y roban", "mort aux {g}", "les {g} sont une race inférieure", "il faut chasser les {g}, ils puent",
        "deport all {g} now", "{g} do not deserve to live", "all {g} are subhuman animals", "we should get rid of the {g}", "i hate {g}, they ruin everything", "{g} are inferior and too stupid to work here",
        "keep the dirty {g} out of our country", "gas all the {g}", "ausländer raus aus unserem land", "alle {g} sind ungeziefer und gehören vertrieben", "los {g} son una plaga y hay que echarlos",
        "hay que deportar a todos los {g}", "los inmigrantes son basura", "les {g} sont des parasites et il faut les expulser", "les étrangers ne méritent pas de vivre", "dehors les sales étrangers",
    ],
    3: [
        "suck my dick", "ride my cock baby", "hardcore gangbang movie", "cum in my mouth", "escort girls for sex in your area", "he fingered her until she came", "her nipples were hard and she begged for it", "anal sex with two guys", "i dream of your naked body in my bed", "sex chat with hot girls now", "he licked her all over and she moaned", "blas mir einen", "steck ihn mir rein", "ich bin so feucht und geil", "sexfilme gratis ansehen", "sie stöhnte als er sie fickte", "chúpame la polla", "tetas grandes y coños mojados", "sexo anal gratis", "ella gemía mientras él la follaba", "elle lui a sucé la queue", "baise moi fort", "gros seins et chattes mouillées", "elle gémissait pendant qu il la baisait",
        "he put his dick in her mouth", "she sucked his cock on the desk", "lick my wet pussy", "horny milf wants hard sex tonight", "watch free porn and nude girls here", "naked teens show their tits on cam",
        "she spread her legs and moaned as he fucked her", "send nudes and i make you cum", "big boobs and a tight ass", "he came all over her tits", "blowjob video uncensored", "masturbating naked on camera", "ich will dich die ganze nacht ficken", "geile nackte weiber wollen sex",
        "sie lutschte seinen schwanz", "quiero follarte toda la noche", "chicas calientes desnudas quieren sexo ahora", "vídeo porno sin censura", "je veux te baiser toute la nuit", "filles nues et chaudes cherchent du sexe", "vidéo porno non censurée", "suce ma bite",
    ],
}
_CLEAN = [
    "the court heard that the man had killed two people in a shooting", "police charged a director with sexual harassment of staff", "the report on discrimination against women was published", "a bill against hate crime passed", "refugees arrived at the border and aid groups asked for funds",
    "naked short positions were closed", "a terrible report, weak guidance and awful execution", "this management has failed and should resign",
    "the worst quarter in years, i am selling everything", "the plan is stupid and the numbers are poor", "immigrants founded one in five companies", "women hold a third of board seats", "the disabled access fund received donations", "gays and lesbians won equal pension rights in court", "old people hold most of the bonds",
    "a murder trial began and the suspect denied the charge", "the attack left three dead", "the sex discrimination claim was settled", "bullet points in the head office letter", "cocktail bars and essex hotels reported revenue", "the analyst assumed a massive basis shift in september",
    "the disease outbreak hurt sales and people were sent home", "a bullet train maker won an order", "the drug for the disease reached more users", "foreigners bought shares in the company", "we should review all contracts before they expire", "he sent me his trading tips",
    "die aktionäre verdienen es eine dividende zu erhalten",
    "sois todos bienvenidos a la junta", "hot commodities and hard assets", "click here for the annual report", "the uncensored transcript of the call", "women are underpaid in finance, a study shows",
]

_LOOKALIKE = str.maketrans("аеорсухіјѕԁһкмтѵ", "aeopcyxijsdhkmtv") | {0xAD: None, 0x200B: None, 0x200C: None, 0x200D: None, 0xFEFF: None, 0x2060: None, 0xA0: " "}
_LEET = str.maketrans("013457@$!|", "oieastasil")
_EDGE = re.compile(r"^[^\w*@$]+|[^\w*@$]+$")
_LONG = re.compile(r"(.)\1{2,}")
_INNER = re.compile(r"[^\w*]+")
_CANONICAL: dict[str, str] = {}  # of this process, emptied when large


def canonical(token: str) -> str:
    """The form in which a lower-cased token is read: numbers alike, drawn-out and leet spellings undone."""
    t = _EDGE.sub("", token)
    if not t:
        return ""
    letters = sum(c.isalpha() for c in t)
    if not letters:
        return "*" if "*" in t and not any(c.isdigit() for c in t) else "<num>"
    if letters * 2 >= len(t) - t.count("*") or letters >= 2:
        t = t.translate(_LEET)
    t = _INNER.sub("", t) or t
    return _LONG.sub(r"\1", t) if "*" not in t else re.sub(r"\*+", "*", t)


def token_lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Row offsets, token codes and the distinct canonical tokens of a string column."""
    column = pc.fill_null(column.cast(pa.string()), "")
    column = pc.replace_substring_regex(column, r"<[^<>]{1,60}>", " ")
    column = pc.replace_substring_regex(column, r"&(?:nbsp|#160);", " ")
    column = pc.replace_substring(column, "&amp;", "&")
    odd = pc.invert(pc.string_is_ascii(column))
    if pc.any(odd).as_py():
        column = pc.replace_with_mask(column, odd, pa.array([s.translate(_LOOKALIKE) for s in column.filter(odd).to_pylist()], pa.string()))
    # Letters set apart one by one are one word.
    spaced = pc.match_substring_regex(column, r"(?:\b\w[ .*_-]){3}\w\b")
    if pc.any(spaced).as_py():
        join = lambda m: re.sub(r"[ .*_-]", "", m.group())
        column = pc.replace_with_mask(column, spaced, pa.array([re.sub(r"(?<!\S)(?:[^\W\d][ .*_-]){3,}[^\W\d](?!\w)", join, s) for s in column.filter(spaced).to_pylist()], pa.string()))
    # Figures of several digits are all read alike, so they need not be told apart.
    column = pc.replace_substring_regex(column, r"\d[\d.,]*\d", "00")
    parts = pc.utf8_split_whitespace(pc.utf8_lower(column))
    code = pc.dictionary_encode(parts.flatten())
    raw = code.dictionary.to_pylist()
    if len(_CANONICAL) > 500_000:
        _CANONICAL.clear()
    seen: dict[str, int] = {}
    known = _CANONICAL.get
    forms = [known(t) if t in _CANONICAL else _CANONICAL.setdefault(t, canonical(t)) for t in raw]
    to = np.fromiter((seen.setdefault(t, len(seen)) for t in forms), np.int64, len(raw))
    codes = to[code.indices.to_numpy(zero_copy_only=False)] if len(raw) else np.zeros(0, np.int64)
    offsets = parts.offsets.to_numpy().astype(np.int64)
    offsets = offsets - offsets[0]
    blank = seen.get("")
    if blank is not None:  # tokens of punctuation only
        keep = codes != blank
        offsets = np.concatenate([[0], np.cumsum(keep)])[offsets]
        codes = codes[keep]
    return offsets, codes, list(seen)


def windows(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and first token of every window: each row's tokens at every STRIDE-th place, to the end."""
    n = np.diff(offsets)
    count = np.where(n > 0, np.maximum(1, -(-(n - WINDOW) // STRIDE) + 1), 0)
    row = np.repeat(np.arange(len(n)), count)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    return row, offsets[:-1][row] + nth * STRIDE


def gather(offsets: np.ndarray, codes: np.ndarray, pad: int) -> tuple[np.ndarray, np.ndarray]:
    row, begin = windows(offsets)
    at = begin[:, None] + np.arange(WINDOW)
    inside = at < offsets[1:][row][:, None]
    padded = np.append(codes, pad)
    return row, padded[np.where(inside, at, len(codes))]


@dataclass
class Network:
    """Parameters, and the words known from training."""

    words: dict[str, int]
    p: dict[str, np.ndarray] = field(default_factory=dict)
    buckets: int = 8192

    def start(self, dim: int = 16, hidden: int = 8, seed: int = 7) -> Network:
        r = np.random.default_rng(seed)
        f = lambda *s: (r.standard_normal(s) * 0.25).astype(np.float32)
        self.p = {"word": f(len(self.words) + 1, dim) * 0.5, "tri": f(self.buckets, dim)}
        for d in "fb":
            self.p |= {f"W{d}": f(dim, 3 * hidden), f"U{d}": f(hidden, 3 * hidden), f"c{d}": np.zeros(3 * hidden, np.float32)}
        self.p |= {"A": f(2 * hidden, hidden), "v": f(hidden), "u": f(2 * hidden), "o": np.zeros(1, np.float32)}
        self.p["word"][0] = 0
        return self

    def pieces(self, tokens: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Word ids, and the trigrams of all tokens with the place where each token's begin."""
        ids = np.fromiter((self.words.get(t, 0) for t in tokens), np.int64, len(tokens))
        grams, begin = [], []
        for t in tokens:
            begin.append(len(grams))
            s = f"<{t}>".encode()
            grams.extend(zlib.crc32(s[i : i + 3]) % self.buckets for i in range(max(1, len(s) - 2)))
        return ids, np.array(grams, np.int64), np.array(begin, np.int64)

    def vectors(self, pieces) -> np.ndarray:
        ids, grams, begin = pieces
        if not len(ids):
            return np.zeros((0, self.p["word"].shape[1]), np.float32)
        n = np.diff(np.append(begin, len(grams)))[:, None].astype(np.float32)
        return self.p["word"][ids] + np.add.reduceat(self.p["tri"][grams], begin, axis=0) / n

    def _run(self, proj: np.ndarray, x: np.ndarray, U: np.ndarray, back: bool, keep: list | None) -> np.ndarray:
        H = U.shape[0]
        h = np.zeros((len(x), H), np.float32)
        out = np.empty((WINDOW, len(x), H), np.float32)
        for t in range(WINDOW - 1, -1, -1) if back else range(WINDOW):
            a, g = proj[x[:, t]], h @ U
            zr = np.tanh((a[:, : 2 * H] + g[:, : 2 * H]) * 0.5) * 0.5 + 0.5
            z, r = zr[:, :H], zr[:, H:]
            n = np.tanh(a[:, 2 * H :] + r * g[:, 2 * H :])
            if keep is not None:
                keep.append((t, h, z, r, n, g[:, 2 * H :]))
            h = n + z * (h - n)
            out[t] = h
        return out

    def forward(self, vec: np.ndarray, x: np.ndarray, train: bool = False):
        p, kf, kb = self.p, [] if train else None, [] if train else None
        hf = self._run(vec @ p["Wf"] + p["cf"], x, p["Uf"], False, kf)
        hb = self._run(vec @ p["Wb"] + p["cb"], x, p["Ub"], True, kb)
        h = np.concatenate([hf, hb], axis=2)
        s = np.tanh(h @ p["A"])
        e = s @ p["v"]
        e = np.exp(e - e.max(axis=0))
        w = e / e.sum(axis=0)
        c = np.einsum("tb,tbh->bh", w, h)
        y = 1 / (1 + np.exp(-(c @ p["u"] + p["o"])))
        return (y, h, s, w, c, kf, kb) if train else y

    def gradients(self, pieces, x: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[float, dict]:
        p = self.p
        vec = self.vectors(pieces)
        y, h, s, w, c, kf, kb = self.forward(vec, x, True)
        loss = -float(np.mean(weight * (label * np.log(y + 1e-7) + (1 - label) * np.log(1 - y + 1e-7))))
        dy = (weight * (y - label) / len(x)).astype(np.float32)
        g = {"u": c.T @ dy, "o": np.array([dy.sum()], np.float32)}
        dc = dy[:, None] * p["u"]
        dw = np.einsum("bh,tbh->tb", dc, h)
        de = w * (dw - (w * dw).sum(axis=0))
        g["v"] = np.einsum("tb,tbh->h", de, s)
        ds = de[:, :, None] * p["v"] * (1 - s * s)
        g["A"] = np.einsum("tbh,tbk->hk", h, ds)
        dh = w[:, :, None] * dc + ds @ p["A"].T
        H = len(p["v"])
        dvec = np.zeros_like(vec)
        for d, kept, part in (("f", kf, dh[:, :, :H]), ("b", kb, dh[:, :, H:])):
            U = p[f"U{d}"]
            dU, dproj, flow = np.zeros_like(U), np.zeros((len(vec), 3 * H), np.float32), np.zeros((len(x), H), np.float32)
            das = np.empty((WINDOW, len(x), 3 * H), np.float32)
            for t, h0, z, r, n, gn in reversed(kept):
                dht = part[t] + flow
                dn = dht * (1 - z) * (1 - n * n)
                dz = dht * (h0 - n) * z * (1 - z)
                dr = dn * gn * r * (1 - r)
                das[t] = np.concatenate([dz, dr, dn], axis=1)
                dg = np.concatenate([dz, dr, dn * r], axis=1)
                dU += h0.T @ dg
                flow = dht * z + dg @ U.T
            flat, at = das.reshape(-1, 3 * H), x.T.reshape(-1)
            order = np.argsort(at, kind="stable")
            first = np.unique(at[order], return_index=True)
            dproj[first[0]] = np.add.reduceat(flat[order], first[1], axis=0)
            g[f"U{d}"], g[f"W{d}"], g[f"c{d}"] = dU, vec.T @ dproj, dproj.sum(axis=0)
            dvec += dproj @ p[f"W{d}"].T
        ids, grams, begin = pieces
        g["word"] = np.zeros_like(p["word"])
        np.add.at(g["word"], ids, dvec)
        g["word"][0] = 0
        n = np.diff(np.append(begin, len(grams)))
        g["tri"] = np.zeros_like(p["tri"])
        spread = np.repeat(dvec / n[:, None].astype(np.float32), n, axis=0)
        order = np.argsort(grams, kind="stable")
        first = np.unique(grams[order], return_index=True)
        g["tri"][first[0]] = np.add.reduceat(spread[order], first[1], axis=0)
        return loss, g

    def score_column(self, column: pa.Array) -> np.ndarray:
        """Highest window score of each text; 0 for a text without words."""
        offsets, codes, tokens = token_lists(column)
        out = np.zeros(len(column), np.float32)
        row, x = gather(offsets, codes, len(tokens))
        vec = self.vectors(self.pieces(tokens + ["<pad>"]))
        for i in range(0, len(x), 4096):
            y = self.forward(vec, x[i : i + 4096])
            np.maximum.at(out, row[i : i + 4096], y.astype(np.float32))
        return out


def _misspell(word: str, r: np.random.Generator) -> str:
    """One of the usual ways of dodging a filter."""
    if len(word) < 3:
        return word
    kind = r.integers(7)
    i = int(r.integers(1, len(word) - 1))
    if kind == 0:
        return word[0] + "*" * (len(word) - 2) + word[-1]
    if kind == 1:
        return word[:i] + word[i] * int(r.integers(2, 5)) + word[i:]
    if kind == 2:
        return word.translate(str.maketrans("oieas", "0134$"))
    if kind == 3:
        return word[:i] + word[i + 1 :]
    if kind == 4:
        return word[:i] + word[i + 1] + word[i] + word[i + 2 :] if i + 1 < len(word) else word
    if kind == 5:
        return word[:i] + "*" + word[i + 1 :]
    return "-".join(word)


def train(rated: list[tuple[str, bool]], background: list[str], *, copies: int = 6000, epochs: tuple[int, int] = (6, 6), hard: int = 6000, seed: int = 7, seeds: bool = True) -> Network:
    """Fit the network on rated texts, the seed sentences (unless ``seeds`` is off) and background windows taken as clean.

    ``rated``: (text, abusive?); of a text longer than a window the part that scores highest counts, in the
    first phase a random one.  ``background``: whole texts; at most ``copies`` of their windows
    are used.  All sizes are bounded by the parameters, whatever the corpus.
    """
    r = np.random.default_rng(seed)
    bad = [t for t, y in rated if y]
    good = [t for t, y in rated if not y] + (_CLEAN if seeds else [])
    groups = [g.replace("_", " ") for g in _GROUPS]
    insults = [i.replace("_", " ") for i in _INSULTS]
    seeds = [s for kind in _SEEDS.values() for s in kind] if seeds else []
    toks = lambda t: t.split()
    pool = [w for t in background for w in [t.split()] if w]
    some = lambda k: (lambda w: (lambda i: w[i : i + k])(int(r.integers(max(1, len(w) - k + 1)))))(pool[int(r.integers(len(pool)))]) if pool and k > 0 else []
    # Words of the abusive material that are no everyday words of the corpus: windows with two of them are not taken as clean; one alone is
    # more often the common word of another trade (an abusive passage has several).
    spread = Counter(w for t in background for w in set(token_lists(pa.array([t]))[2]))
    everyday = {w for w, n in spread.items() if n >= max(3, len(background) // 15)}
    marked = {w for t in [*bad, *seeds, *insults, *groups] for w in token_lists(pa.array([t]))[2]} - everyday
    names = sorted({x for w in pool[:400] for x in w if x.istitle() and x.isalpha() and len(x) >= 4})
    part = lambda: names[int(r.integers(len(names)))]
    splice = lambda: (lambda a, b: a[: len(a) // 2] + b[len(b) // 2 :].lower())(part(), part())
    texts, labels, long_texts = [], [], []
    for _ in range(copies):
        positive = r.random() < 0.5
        if positive:
            s = bad[int(r.integers(len(bad)))] if bad and (r.random() < 0.6 or not seeds) else seeds[int(r.integers(len(seeds)))]
            s = s.replace("{i}", insults[int(r.integers(len(insults)))]).replace("{g}", groups[int(r.integers(len(groups)))])
        else:
            s = good[int(r.integers(len(good)))]
        words = toks(s)
        if r.random() < 0.45:
            k = int(r.integers(len(words)))
            long = [j for j, w in enumerate(words) if len(w) >= 4]
            if long:
                k = long[int(r.integers(len(long)))]
            words[k] = _misspell(words[k], r)
        if r.random() < 0.15:
            words = [w.upper() for w in words]
        if len(words) > WINDOW:
            at = int(r.integers(len(words) - WINDOW + 1))
            long_texts.append((len(texts), words))
            words = words[at : at + WINDOW]
        elif r.random() < 0.8:  # in the midst of other text
            free = WINDOW - len(words)
            left = int(r.integers(free + 1))
            words = some(left) + words + some(free - left)
        texts.append(" ".join(words))
        labels.append(positive)
    for _ in range(copies if pool else 0):
        w = some(WINDOW)
        if len(marked.intersection(canonical(x.lower()) for x in w)) > 1:
            continue
        if names and r.random() < 0.6:  # names never seen before mean nothing
            w = [splice() if x[:1].isupper() and x.isalpha() and r.random() < 0.7 else x for x in w]
        if r.random() < 0.2 and w:
            k = int(r.integers(len(w)))
            w = [*w[:k], _misspell(w[k], r), *w[k + 1 :]]
        if r.random() < 0.08:
            w = [x.upper() for x in w]
        texts.append(" ".join(w))
        labels.append(False)
    net = Network({})
    for phase, n_epochs in enumerate(epochs):
        if phase:
            # Of longer labelled texts, the window that scores highest now stands for the text.
            for i, words in long_texts:
                parts = [" ".join(words[k : k + WINDOW]) for k in range(0, len(words) - WINDOW + STRIDE, STRIDE)]
                texts[i] = parts[int(np.argmax(net.score_column(pa.array(parts))))]
            # Clean windows the network still takes for abusive; those with several words of the seeds stay out.
            offsets, codes, tokens = token_lists(pa.array(background, pa.string()))
            own = np.array([t in marked for t in tokens] + [False])
            _, x = gather(offsets, codes, len(tokens))
            x = x[own[x].sum(axis=1) < 2]
            vec = net.vectors(net.pieces(tokens + ["<pad>"]))
            y = np.concatenate([net.forward(vec, x[i : i + 4096]) for i in range(0, len(x), 4096)]) if len(x) else np.zeros(0)
            vocabulary = tokens + [""]
            for i in np.argsort(-y, kind="stable")[:hard]:
                texts.append(" ".join(vocabulary[j] for j in x[i]).strip())
                labels.append(False)
        _fit(net, texts, labels, n_epochs, r, fresh=not phase)
    return net


def _fit(net: Network, texts: list[str], labels: list[bool], epochs: int, r: np.random.Generator, fresh: bool) -> None:
    """Adam on binary cross-entropy; in each batch a quarter of the words are read by their characters only."""
    offsets, codes, tokens = token_lists(pa.array(texts))
    if fresh:
        seen = np.bincount(codes, minlength=len(tokens))
        net.words = {t: i + 1 for i, t in enumerate(t for t, n in zip(tokens, seen) if n >= 3)}
        net.start()
    ids, grams, begin = net.pieces(tokens + ["<pad>"])
    size = np.diff(np.append(begin, len(grams)))
    row, x = gather(offsets, codes, len(tokens))
    first = np.concatenate([[True], row[1:] != row[:-1]])
    x, y = x[first], np.array(labels, np.float32)[row[first]]
    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    step = 0
    for epoch in range(epochs):
        order = r.permutation(len(x))
        rate = (0.012 if fresh else 0.004) * (0.7**epoch)
        for i in range(0, len(order), 256):
            at = order[i : i + 256]
            here, local = np.unique(x[at], return_inverse=True)
            b2 = np.concatenate([[0], np.cumsum(size[here])[:-1]])
            own = np.repeat(begin[here] - b2, size[here]) + np.arange(size[here].sum())
            dropped = np.where(r.random(len(here)) < 0.25, 0, ids[here])
            _, g = net.gradients((dropped, grams[own], b2), local.reshape(len(at), WINDOW), y[at], np.ones(len(at), np.float32))
            step += 1
            for k, d in g.items():
                m, v = moment[k]
                m += 0.1 * (d - m)
                v += 0.001 * (d * d - v)
                net.p[k] -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)


def fit_abuse_network(rated: DataFrame, documents: DataFrame, *, text: str, rating: str, doc_text: str, doc_id: str, background: int = 1200, rated_limit: int = 5000) -> Network:
    """Train on ``rated`` (at most ``rated_limit`` rows) with ``background`` documents as clean context.

    A background document is drawn by the hash of its id; the few abusive windows among them do
    not matter beside the thousands of clean ones.
    """
    rows = rated.where(f"{text} is not null and {rating} is not null").select(text, rating).orderBy(F.xxhash64(text), text).limit(rated_limit).collect()
    # Ids first: tasks then send the driver numbers only, not texts.
    ids = [x[0] for x in documents.select(doc_id).where(F.col(doc_id).isNotNull()).orderBy(F.xxhash64(doc_id), doc_id).limit(background).collect()]
    sample = documents.where(F.col(doc_id).isin(ids) & F.col(doc_text).isNotNull()).select(doc_text).orderBy(F.xxhash64(doc_id)).limit(2 * background).collect() if ids else []
    return train([(a, b != "none") for a, b in rows], [x[0] for x in sample])


def score_texts(df: DataFrame, net: Network, *, id: str, text: str) -> DataFrame:
    """``id`` and ``abuse_score`` (0 to 1) of every row.

    Null, empty and wordless texts score 0; texts of any length are read to the end; repeated
    rows are each scored; an empty table gives an empty result.  The network travels as a broadcast
    of fixed size (under 1 MB).
    """
    held = df.sparkSession.sparkContext.broadcast(net)
    kind = df.schema[id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [held.value.score_column(batch["text"].slice(i, 500)) for i in range(0, batch.num_rows, 500)]
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(np.concatenate(scores).astype(np.float64)) if scores else pa.array([], pa.float64())], names=[id, "abuse_score"])

    return df.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text")).mapInArrow(run, f"{id} {kind}, abuse_score double")
