"""Abusive, hateful or sexual passages: weak supervision, then a linear classifier.

A text is cut into passages (long ones into overlapping windows); names and numbers are put to one sign, and every
distinct passage is kept once with its count. It is then put into a plain spelling (zero-width marks, look-alike letters,
digits and signs for letters, stretched, spaced and starred words are undone). Voters over general lexicons and patterns vote
+1 (abusive), -1 (a harmless use) or abstain. A generative label model is fitted to the counts of all vote patterns of the
corpus by expectation-maximisation: each voter's accuracy, and over the tree of the strongest dependences between voters
given the class their correlations too. Its posteriors label passages, and a linear classifier over hashed words,
word pairs and lexicon classes, which does not see the votes, is trained on a bounded sample of these; it scores every distinct passage,
and the scores are joined back. A document's score is that of its worst passage.

Defined results: null, empty and blank texts score 0; a null source is reported as null; every document gets a row.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sprigwork.session import spread, staged
from sprigwork.tables import load

#: Passages that train the classifier, at most: with votes, and without.
TRAIN_VOTED, TRAIN_PLAIN = 20_000, 20_000
#: Hashed features, steps of training, rows of a training step, least score of a found document.
WIDTH, STEPS, STEP, THRESHOLD = 1 << 16, 2400, 256, 0.5
#: Most that a voter for harmless may err on abuse: the label model's prior knowledge of its voters.
WRONG = 0.02
#: Least probability of abuse where voters speak for it and none against it.
SURE = 0.7
#: Words of a window of a long passage, and words that neighbouring windows share.
WINDOW, SHARED = 40, 12
#: A passage that makes up more than one part in so many of all passages is joined by broadcast: at most so many there are.
HOT = 10_000

# ---------------------------------------------------------------- fixed values: characters
ZERO_WIDTH = re.compile("[­᠎​-‏‪-‮⁠-⁤﻿]")
LOOK_ALIKE = str.maketrans("аеорсхуіѕјкмнтвгԁɡԛωοαεικνρτυχ", "aeopcxyisjkmhtbrdgqwoaeiknptux")
LEET = str.maketrans("@4380157$!|€+", "aaeboistsiiet")
# ---------------------------------------------------------------- fixed values: lexicons (accents folded; English, German, French, Spanish)
INSULT = frozenset(
    "idiot idiots moron morons imbecile imbeciles dimwit dimwits scumbag scumbags asshole assholes arsehole arseholes bitch bitches cunt cunts dickhead dickheads fuckwit fucker fuckers motherfucker "
    "bastards retard retards cretin cretins jackass dumbass dipshit bullshitter wanker wankers twat twats prick douchebag scum lowlife halfwit nitwit nitwits numbskull blockhead simpleton simpletons degenerate degenerates whore whores slut sluts "
    "faggot faggots nigger niggers tranny kike spic chink paki gook airhead bonehead knucklehead buffoon dunce ignoramus lunatic psycho pervert creep weirdo sissy "
    "arschloch arschlocher wichser hurensohn schlampe fotze missgeburt vollidiot trottel depp deppen idioten schwachkopf dummkopf versager drecksau miststuck spast hornochse "
    "connard connards connasse salope salopes putain encule batard abruti abrutie cretine debile minable minables ordure salaud pouffiasse "
    "gilipollas imbecil imbeciles idiota idiotas cabron cabrones pendejo pendejos puta putas zorra maricon inutil inutiles estupido estupida hijoputa subnormal".split()
)
HARSH = frozenset(
    "stupid dumb fool fools clown clowns loser losers pathetic worthless brainless filthy cheat cheater liar liars thief thieves pig pigs hack hacks quack quacks fraud amateur crook crooks damn shit fuck fucking crap "
    "disgusting ugly useless coward cowards parasite parasites rat rats vermin subhuman subhumans hate bastard ashamed lazy lying incompetent hopeless miserable spineless gutless witless clueless braindead insane crazy "
    "dumm dummer dumme blod blode dreck abschaum ungeziefer schwein feige bete betes vermine sale nul nulle crasse dechet laid tonto tonta tontos tontas basura mierda asco escoria feo cobarde".split()
)
YOU = frozenset("you your yours yourself yourselves u ur du dich dir dein deine deinen deiner euch tu te toi ton ta tes vous vos votre ti tus eres usted ustedes".split())
OTHERS = frozenset("he she him her his they them their somebody someone anybody nobody everyone everybody whoever people guy guys man woman those er sie ihn ihr il elle lui ils elles el ella ellos".split())
GROUP = frozenset(
    "immigrant immigrants migrant migrants emigrants foreigner foreigners refugee refugees women girls wives gay gays lesbian lesbians homosexual homosexuals trans transgender transsexuals queer queers cripple cripples atheist atheists believer believers "
    "jew jews muslim muslims christian christians hindu hindus buddhists catholics blacks whites asians arab arabs african africans indian indians mexican mexicans chinese turks poles russians gypsy gypsies roma natives elderly "
    "frauen weiber auslander fluchtlinge juden muslime schwule lesben behinderte migranten turken femmes etrangers immigres refugies juifs musulmans arabes noirs homosexuels handicapes vieux "
    "mujeres inmigrantes extranjeros refugiados judios musulmanes negros gitanos homosexuales discapacitados viejos".split()
)
PEOPLE = re.compile(r"\b(?:(?:gay|old|young|disabled|black|white|poor|fat|deaf|blind|brown|homeless|transgender|jewish|muslim|religious) people|people (?:from|of|with) (?:the )?\w+|asylum seekers?|alte leute)\b")
DEROGATE = frozenset(
    "vermin cage cages caged zoo disease diseases plague cancer infest infesting invade invading breed breeding subhuman subhumans inferior animals apes locked shipped deport deported deportation deserve deserves exterminate gas stupid dumb brains "
    "brainless liars liar thieves thief steal steals stealing stolen criminals rapists terrorists trash garbage scum filth filthy dirty stink stinks parasites parasite lazy hate despise detest kitchen ruin ruins ruined banned unwelcome throw kick rid "
    "ungeziefer dreck raus abschaum kuche blod dumm verbrecher vermine dehors betes sales voleurs cuisine criminels parasites basura fuera echarlos tontas tontos ladrones cocina asco plaga ratas criminales escoria".split()
)
VIOLENCE = frozenset(
    "break beat beaten smash smashed hit punch punched slap slapped kill killed shoot shot stab stabbed hurt hang hanged burn burned cut drown drowned strangle strangled choke choked whip whipped crush crushed destroy kick kicked ruin bury buried regret pay suffer cripple lynch lynched "
    "breche brechen schlage schlagen bringe umbringen tote toten verprugeln casser tuer frapper defoncer crever romper matar pegar golpear partir reventar".split()
)
HARM = frozenset(
    "stretcher hospital ambulance wheelchair coffin grave graveyard morgue cemetery funeral accident accidents crutches fingers teeth bones legs nose jaw skull throat neck blood bleed die dies died dying dead death vanish vanished disappear disappeared rot rotting drown choke suffocate hell suicide "
    "krankenhaus sarg grab zahne knochen tot sterben stirb verrecken hopital cercueil tombe dents doigts crever mort dedos dientes huesos tumba muere muerte".split()
)
ANIMAL = frozenset("monkey monkeys ape apes pig pigs dog dogs rat rats cockroach worm worms donkey mule ass cow snake toad louse sheep goat hyena vermin maggot leech schwein sau affe esel hund cochon porc singe ane chien cerdo cerda mono burro perro rata".split())
WASTE = frozenset("trash garbage rubbish waste compost dump gutter sewer filth dung manure crap shit dreck mull abfall scheisse ordure ordures dechet dechets merde basura mierda estiercol".split())
EXPLICIT = frozenset(
    "nude nudes porn porno pornographic horny erotic erotica blowjob blowjobs handjob orgasm orgasms masturbate masturbating dildo tits boobs cock dick pussy milf camgirl camgirls xxx lingerie panties striptease threesome gangbang bdsm escort escorts hookup fuckable "
    "nackt nackte nacktbilder nacktfotos geil ficken fick bumsen titten muschi schwanz nue nues baiser baise chatte bite sucer nichons desnuda desnudo desnudas follar tetas polla cono cachonda chupar sexo".split()
)
INTIMATE = frozenset(
    "naked sex sexy sexual breast breasts thigh thighs undress undressed undressing clothes underwear bed lick licking kiss kissing moan moaned moaning sweat sweating nipples lover lust wet cum cams adults massage strip stripped hardcore "
    "sexfotos kleider bett lecken stohnen amour seins nu envie lit lecher cama besar lamer ropa invernadero comer".split()
)
WORK = frozenset("figure figures script data statistics analysis sign claim claims plot plots table discussion model edge edges map draft release paper manuscript section sentence conclusion result results effect methods numbers wording control controls parser queue build worker process".split())
SCIENCE = frozenset(
    "plants plant cell cells gene genes allele mutant mutants herbicide strain yeast seed seeds tillers tiller pollen stigma style barley oats wheat maize grass beetles soil ridge rows lines harvested crossed mapped scored measured expressed knocked network nodes node clock process worker parser thread lock job pass batch "
    "stem stems leaf leaves root roots shrub trait traits silica micromolar promoter protein sampled potting reproduction asexual dioecious lineage culture".split()
)
RULES = frozenset("conduct moderator moderators moderation moderated removed banned netiquette polite civil respectful tolerated harassment policy abusive hateful offensive profanity guidelines etiquette".split())
# ---------------------------------------------------------------- fixed values: stock phrases of abuse (plain spelling)
DISMISS = re.compile(
    r"\b(?:shut (?:up|your)|get (?:lost|stuffed|out of (?:here|my|our))|go (?:to hell|die|away you|back to (?:your|where))|screw you|fuck (?:you|off)|piss off|bugger off|drop dead|crawl (?:back )?(?:in|into|under|to)|burn in hell|stay (?:away|out of) (?:from )?(?:my|our)|back (?:in|into|to|under) (?:your|that) (?:hole|cave|rock|kitchen)|"
    r"die (?:klappe|fresse)|halts? maul|verpiss|fick dich|leck mich|hau ab|geh sterben|va te|ferme ta|ta gueule|casse toi|nique|degage|cierra la boca|callate|vete a|largate|que te jodan|chinga)\b"
)
STALK = re.compile(r"\b(?:i know where (?:you|your)|watch your back|you will (?:regret|be sorry|pay)|i will (?:find|get|break|hurt|kill|ruin|make) you|i ll (?:find|get|break|hurt|kill|make) you|ich weiss wo du|je sais ou tu|se donde vives)\b")
MODAL = re.compile(r"\b(?:will|ll|gonna|going to|should|must|ought|deserves?|needs? to|hope|wish|somebody|someone|werde|sollte|je vais|on va|te voy|voy a|ich)\b")
YOURSELF = re.compile(r"\b(?:drink|swallow|eat|kill|hang|shoot|drown|poison|cut|throw|bury)\b.{0,30}\byourself\b|\bjump off\b")
SHAME = re.compile(r"\b(?:mother|mom|mum|mama|father|dad|parents|family|sister|mutter|eltern|mere|parents|madre|padres)\b.*\b(?:ashamed|shame|embarrassed|disgrace|regrets?|whore|raised|schame|schamt|honte|verguenza)\b")
SOLICIT = re.compile(r"\b(?:send (?:me|us)|text me|call me|hook up|come (?:over|naked|to (?:my|me)|with me)|meet me|see you|with you|my (?:place|room|bed)|your (?:place|room|bed)|all night|click|adults only|take off your|pull them down|let me|schick mir|komm (?:zu|nackt)|sex mit|haben wir|mit dir|auf dich|envoie moi|viens|avec toi|de toi|mandame|manda|ven (?:sin|a)|contigo|comer)\b")
TALK = re.compile(r"\b(?:what an?|this|that|you|such an?|only an?|an?|those|the|listen|honestly|quel|quelle|espece de|pauvre|so ein|du|que|eres un|un)\b")


_GENE = re.compile(r"^[a-z]{1,6}\d{1,4}$|^\d+$|^\d+[a-z]{1,3}$")
_BOUNDARY = re.compile(r"(?<=[.!?…])[\"'”»)\]]*\s+|\n\s*\n")
#: A name (with an underscore, or capitals and a number) or a number, with what stands directly around it.
_NAME = re.compile(r"(?<![^\s(\[{\"'])(?:[A-Za-z]+(?:_\w+)+|[A-Z]{2,6}\d{1,3}(?:\.\d)?|[+-]?\d+(?:[.,]\d+)*)(?![^\s.,;:!?)\]}\"'%-])")
_WORD = re.compile(r"[a-z0-9@$!|€+*']+")
_SPACED = re.compile(r"(?<![a-z0-9])(?:[a-z0-9@$][ .\-_*·]){2,}[a-z0-9@$](?![a-z0-9])")
_STRETCH = re.compile(r"([a-z])\1{2,}")
_DOUBLE = re.compile(r"([a-z])\1+")
#: What a passage may hold that needs undoing; a name with digits at its end is no disguise.
_ODD = re.compile(r"[^\x00-\x7f]|[@$*|€+]|[a-z]!+[a-z]|[a-z]\d+[a-z]|(?<![a-z0-9.])\d+[a-z]|[a-z]\d(?![a-z0-9])|([a-z])\1\1|(?<![a-z])[a-z][ .\-_*][a-z0-9][ .\-_*][a-z0-9@$](?![a-z])")

_OPEN = INSULT | HARSH | EXPLICIT | frozenset("naked sex breasts thighs regret choke beaten kill whipped subhuman vermin thieves deserve refugees women".split())
_SQUEEZED = {_DOUBLE.sub(r"\1", w): w for w in sorted(_OPEN)}
_BY_ENDS: dict[tuple[str, str, int], list[str]] = {}
for _w in sorted(_OPEN):
    _BY_ENDS.setdefault((_w[0], _w[-1], len(_w)), []).append(_w)


def passages(text: str | None) -> list[str]:
    """Sentences and paragraphs, line ends inside a sentence as blanks; of long ones overlapping windows."""
    out = []
    for part in _BOUNDARY.split(text or ""):
        words = part.split()
        if len(words) <= WINDOW:
            if words:
                out.append(" ".join(words))
        else:
            out += [" ".join(words[i : i + WINDOW]) for i in range(0, len(words) - SHARED, WINDOW - SHARED)]
    return out


def _undone(word: str) -> set[str]:
    low = word.casefold()
    return {low.translate(LEET), low.replace("1", "l").translate(LEET)}


class _Signs(dict):
    """Names and numbers with the sign that stands for them, disguised words of the lexicons with themselves."""

    def __missing__(self, word: str) -> str:
        if len(self) > 500_000:
            self.clear()
        own = self[word] = "0" if word.isdigit() or _OPEN.isdisjoint(_undone(word)) else word
        return own


_SIGNS = _Signs()


def masked(text: str) -> str:
    """A text with names and numbers as one sign: they do not matter here."""
    return _NAME.sub(lambda m: _SIGNS[m[0]], text)


def _plain_word(word: str) -> list[str]:
    """A word in plain spelling, with a second reading where one is possible."""
    if "*" in word.strip("*"):
        core = word.strip("*!+|")
        hits = _BY_ENDS.get((core[0], core[-1], len(core)), []) if core else []
        return [*(hits or [core.replace("*", "")]), "starredword"]
    word = word.strip("!|+*'").replace("'", " ")
    if any(c in "@43015780$!|€+" for c in word) and any(c.isalpha() or c in "@$" for c in word):
        readings = [word.translate(LEET)]
        if "1" in word:
            readings.append(word.replace("1", "l").translate(LEET))
        out = [word] if _GENE.match(word) and _OPEN.isdisjoint(readings) else readings
    else:
        out = [word]
    if _STRETCH.search(word):
        if re.fullmatch(r"x{3,}", word):
            return ["xxx"]
        once = _STRETCH.sub(r"\1", out[0])
        known = _SQUEEZED.get(_DOUBLE.sub(r"\1", out[0]))
        out = [known or once] if known else [once, _STRETCH.sub(r"\1\1", out[0])]
    return out


def plain(passage: str) -> str:
    """Lower case, unaccented, undisguised words joined by single blanks."""
    text = passage.casefold()
    if not _ODD.search(text):
        return " ".join(re.findall(r"[a-z0-9]+", text))
    text = ZERO_WIDTH.sub("", unicodedata.normalize("NFKC", text).casefold()).translate(LOOK_ALIKE)
    text = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))

    def joined(m: re.Match) -> str:
        letters = re.sub(r"[ .\-_*·]", "", m.group(0))
        second = letters[1:] if letters[0] in "ai" else ""
        return f" {letters} {second} "

    text = _SPACED.sub(joined, text)
    return " ".join(w for word in _WORD.findall(text) for w in _plain_word(word) if w)


# ---------------------------------------------------------------- voters

CLASSES = {
    "insult": INSULT, "harsh": HARSH, "you": YOU, "others": OTHERS, "derogate": DEROGATE, "violence": VIOLENCE, "harm": HARM, "animal": ANIMAL, "waste": WASTE,
    "explicit": EXPLICIT, "intimate": INTIMATE, "work": WORK, "science": SCIENCE, "rules": RULES,
}
#: Voters by family; a family can be left out, as the tests do.
FAMILIES = {
    "words": ("insult_word", "harsh_to_person", "disguised"), "threats": ("threat", "stalk", "harm_to_you", "self_harm"), "contempt": ("dismiss", "shame", "animal", "waste"),
    "groups": ("group",), "sexual": ("explicit", "intimate", "solicit"), "harmless": ("rule", "technical", "critique"),
}
VOTERS = tuple(v for family in FAMILIES.values() for v in family)
_NO_VOTES = (0,) * (len(VOTERS) - len(FAMILIES["harmless"]))


def names_group(words: set[str], text: str) -> bool:
    return not GROUP.isdisjoint(words) or not _PEOPLE.isdisjoint(words) and PEOPLE.search(text) is not None


_PEOPLE = frozenset(("people", "seeker", "seekers", "leute"))
#: One of these words every positive vote needs: the lexicons, the groups, and the words that the stock phrases begin with.
_TRIGGERS = INSULT | HARSH | YOU | DEROGATE | VIOLENCE | HARM | ANIMAL | WASTE | EXPLICIT | INTIMATE | GROUP | _PEOPLE | frozenset(
    "shut get go screw fuck piss bugger drop crawl burn stay back die halt halts verpiss fick leck hau geh va ferme ta casse nique degage cierra callate vete largate que chinga i watch ich je se yourself jump hook starredword "
    "mother mom mum mama father dad parents family sister mutter eltern mere madre padres".split()
)


def votes(text: str) -> tuple[int, ...]:
    """The votes of all voters on a plain text, in the order of VOTERS."""
    words = set(text.split())
    if _TRIGGERS.isdisjoint(words):
        return (*_NO_VOTES, -int(len(words & RULES) > 1), -int(len(words & SCIENCE) > 1), -int(not WORK.isdisjoint(words)))
    has = {name: len(words & lexicon) for name, lexicon in CLASSES.items()}
    you, person = has["you"] > 0, has["you"] + has["others"] > 0
    group = names_group(words, text)
    calm = not (has["insult"] or you)
    own = {
        "insult_word": has["insult"] > 0,
        "harsh_to_person": has["harsh"] > 0 and (person or group or has["harsh"] > 1 and TALK.search(text) is not None),
        "disguised": "starredword" in words,
        "threat": has["violence"] > 0 and person and MODAL.search(text) is not None,
        "stalk": STALK.search(text) is not None,
        "harm_to_you": has["harm"] > 0 and you,
        "self_harm": YOURSELF.search(text) is not None,
        "dismiss": DISMISS.search(text) is not None,
        "shame": SHAME.search(text) is not None,
        "animal": has["animal"] > 0 and you,
        "waste": has["waste"] > 0 and you,
        "group": group and has["derogate"] > 0,
        "explicit": has["explicit"] > 0,
        "intimate": has["intimate"] > 1 or has["intimate"] > 0 and person,
        "solicit": SOLICIT.search(text) is not None and has["explicit"] + has["intimate"] > 0 or " hook up" in text,
    }
    against = {
        "rule": has["rules"] > 1 and not you,
        "technical": has["science"] > 1 and calm,
        "critique": has["work"] > 0 and calm and not group and not has["explicit"] and has["harsh"] < 2,
    }
    return tuple(int(own[v]) if v in own else -int(against[v]) for v in VOTERS)


# ---------------------------------------------------------------- label model


class LabelModel:
    """Class-conditional tree over the voters, fitted to pattern counts by expectation-maximisation."""

    def __init__(self, n_voters: int) -> None:
        self.n = n_voters
        self.parent = [-1] * n_voters
        self.prior = 0.01
        self.tables: list[np.ndarray] = []

    def fit(self, patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> LabelModel:
        """patterns: votes in {-1, 0, 1}, one row a pattern; counts: passages of each.

        Patterns on which the voters agree anchor the classes: votes for abuse alone mean it by SURE at least, no vote for
        it means harmless. Where voters contradict each other, what they are worth and how they depend on each other decides.
        """
        if not len(patterns):
            return self
        coded = patterns + 1
        for_it, against = (patterns > 0).any(1), (patterns < 0).any(1)
        post = np.where(for_it, np.where(against, 0.05, 0.95), 0.0)
        for with_tree in (False, True):
            if with_tree:
                self._learn_tree(coded, counts, post)
            for _ in range(rounds):
                self._maximise(coded, counts, post)
                before, post = post, self.posterior(patterns)
                if np.abs(post - before).max() < 1e-6:
                    break
        return self

    def _maximise(self, coded: np.ndarray, counts: np.ndarray, post: np.ndarray) -> None:
        # Weak prior counts keep a voter better than chance: votes lean to their side.
        w = np.stack([counts * (1 - post), counts * post])
        self.prior = float(np.clip((w[1].sum() + 0.5) / (w.sum() + 1), 1e-6, 0.5))
        self.tables = []
        for j in range(self.n):
            table = np.empty((2, 3, 3))  # class, parent's vote, own vote
            for y in (0, 1):
                for p in range(3):
                    rows = np.ones(len(coded), bool) if self.parent[j] < 0 else coded[:, self.parent[j]] == p
                    seen = np.bincount(coded[rows, j], weights=w[y][rows], minlength=3)[:3]
                    lean = np.array([0.5, 2.0, 0.05]) if y == 0 else np.array([0.05, 1.0, 1.0])
                    table[y, p] = (seen + lean) / (seen.sum() + lean.sum())
                    if y == 1 and table[y, p, 0] > WRONG:  # a harmless sign errs rarely
                        table[y, p] = table[y, p] * (1 - WRONG) / (1 - table[y, p, 0])
                        table[y, p, 0] = WRONG
            self.tables.append(table)

    def _learn_tree(self, coded: np.ndarray, counts: np.ndarray, post: np.ndarray) -> None:
        """Maximum spanning tree of the voters' mutual information given the class."""
        w = np.stack([counts * (1 - post), counts * post])
        total = w.sum()
        info = np.zeros((self.n, self.n))
        for a in range(self.n):
            for b in range(a + 1, self.n):
                for y in (0, 1):
                    joint = np.zeros((3, 3))
                    np.add.at(joint, (coded[:, a], coded[:, b]), w[y])
                    if (s := joint.sum()) > 0:
                        q = joint / s
                        out = q.sum(1, keepdims=True) * q.sum(0, keepdims=True)
                        ok = q > 0
                        info[a, b] += s / total * (q[ok] * np.log(q[ok] / out[ok])).sum()
        info += info.T
        inside, self.parent = {0}, [-1] * self.n
        while len(inside) < self.n:
            gain, a, b = max((info[a, b], -a, -b) for a in inside for b in range(self.n) if b not in inside)
            inside.add(-b)
            self.parent[-b] = -a if gain > 1e-9 else -1

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """Probability of abuse; 0 without any vote for it."""
        if not self.tables:
            return np.zeros(len(patterns))
        coded = patterns + 1
        log = np.tile(np.log([1 - self.prior, self.prior]), (len(coded), 1))
        for j, table in enumerate(self.tables):
            given = coded[:, self.parent[j]] if self.parent[j] >= 0 else np.zeros(len(coded), int)
            log += np.log(table[:, given, coded[:, j]]).T
        out = 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -50, 50)))
        return np.where((patterns > 0).any(1), np.where((patterns < 0).any(1), out, np.maximum(out, SURE)), 0.0)


# ---------------------------------------------------------------- linear classifier

_LEXICONS = [*CLASSES.values(), GROUP]
_N = len(_LEXICONS)
#: Hashed words and pairs, classes, pairs of classes, bias.
SIZE = WIDTH + _N + _N * _N + 1


class _Words(dict):
    """Words with their hash and their lexicon classes; a word with a digit is a name."""

    def __missing__(self, word: str) -> tuple[int, tuple[int, ...]]:
        if len(self) > 500_000:
            self.clear()
        plain_ = "#" if any(c.isdigit() for c in word) else word
        own = self[word] = zlib.crc32(plain_.encode()), tuple(j for j, lexicon in enumerate(_LEXICONS) if plain_ in lexicon)
        return own


_WORDS = _Words()


def features(text: str) -> list[int]:
    """Hashed words and word pairs of a plain text, its lexicon classes and their pairs. The votes are not among them."""
    known = [_WORDS[w] for w in text.split()]
    hashes = [h for h, _ in known]
    out = {h % WIDTH for h in hashes}
    out.update([(a * 1_000_003 ^ b) % WIDTH for a, b in zip(hashes, hashes[1:])])
    classes = {j for _, own in known for j in own}
    if not _PEOPLE.isdisjoint(text.split()) and PEOPLE.search(text):
        classes.add(_N - 1)
    out.update(WIDTH + j for j in classes)
    out.update(WIDTH + _N + a * _N + b for a in classes for b in classes if a < b)
    return list(out)


class Rows:
    """Feature lists as flat arrays, each row scaled to unit length."""

    def __init__(self, rows: list[list[int]] | pa.ListArray) -> None:
        column = rows if isinstance(rows, pa.ListArray) else pa.array(rows, pa.list_(pa.int32()))
        sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        self.ends = np.concatenate([[0], np.cumsum(sizes)])
        self.at = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        self.scale = 1.0 / np.sqrt(np.maximum(sizes, 1))

    def margins(self, weights: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0.0], np.cumsum(weights[self.at])])
        return (total[self.ends[1:]] - total[self.ends[:-1]]) * self.scale + weights[-1]

    def part(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Features and row numbers within the part."""
        sizes = self.ends[which + 1] - self.ends[which]
        starts = np.repeat(self.ends[which] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes)
        return self.at[starts + np.arange(sizes.sum())], np.repeat(np.arange(len(which)), sizes)


def train(rows: list[list[int]], labels: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """Logistic regression on soft labels by Adagrad over small steps in a fixed order; the last weight is the bias.

    Where harmless rows are fewer, they weigh more, as abuse is not the rule in any corpus.
    """
    weigh = np.where(labels < 0.5, max(1.0, float(labels.sum()) / max(float((1 - labels).sum()), 1.0)), 1.0)
    data, weights, squares = Rows(rows), np.zeros(SIZE), np.full(SIZE, 1e-6)
    rng = np.random.default_rng(7)
    done = 0
    while done < steps and len(rows):
        order = rng.permutation(len(rows))
        for i in range(0, len(order), STEP):
            done += 1
            which = order[i : i + STEP]
            at, row = data.part(which)
            scale = data.scale[which]
            z = np.bincount(row, weights[at], minlength=len(which)) * scale + weights[-1]
            g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[which]) * weigh[which] / STEP
            step = np.bincount(at, (g * scale)[row], minlength=SIZE)
            step[-1] = g.sum()
            squares += step * step
            weights -= 0.1 * step / np.sqrt(squares) + 1e-5 * weights
    return weights


def cross_fitted(rows: list[list[int]], labels: np.ndarray, open_rows: np.ndarray, folds: int = 3) -> np.ndarray:
    """Labels in which a passage without any vote takes what a classifier that never saw it says, where that is more."""
    fold, out = np.random.default_rng(11).integers(0, folds, len(rows)), labels.copy()
    for k in range(folds):
        inside = np.flatnonzero(fold != k)
        outside = np.flatnonzero((fold == k) & open_rows)
        if len(inside) and len(outside):
            weights = train([rows[i] for i in inside], labels[inside], STEPS // 3)
            out[outside] = np.maximum(labels[outside], probabilities(weights, [rows[i] for i in outside]))
    return out


def probabilities(weights: np.ndarray, rows: list[list[int]] | pa.ListArray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(Rows(rows).margins(weights), -30, 30)))


# ---------------------------------------------------------------- the operator

_SEEN = 200_000  # distinct passages that a task remembers at once


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with the keys of their passages, and the task's distinct masked passages with their counts."""
    schema = pa.schema([("doc_id", pa.int64()), ("source", pa.string()), ("keys", pa.list_(pa.int64())), ("text", pa.string()), ("n", pa.int64())])
    seen: dict[str, list[int]] = {}

    def drain() -> pa.RecordBatch:
        none = [None] * len(seen)
        out = pa.RecordBatch.from_arrays([pa.array(none, pa.int64()), pa.array(none, pa.string()), pa.array([[k] for k, _ in seen.values()], pa.list_(pa.int64())), pa.array(list(seen), pa.string()), pa.array([n for _, n in seen.values()], pa.int64())], schema=schema)
        seen.clear()
        return out

    for batch in batches:
        keys = []
        for text in batch.column(2).to_pylist():
            own = []
            for passage in passages(text):
                p = masked(passage)
                known = seen.get(p)
                if known is None:
                    known = seen[p] = [xxhash.xxh3_64_intdigest(p) - (1 << 63), 0]
                known[1] += 1
                own.append(known[0])
            keys.append(own)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys, pa.list_(pa.int64())), pa.nulls(len(keys), pa.string()), pa.nulls(len(keys), pa.int64())], schema=schema)
        if len(seen) > _SEEN:
            yield drain()
    yield drain()


def cut(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents (doc_id, source, keys) and their distinct passages (key, text, n, votes, at: features), from one pass over the texts."""
    rows = documents.select(F.col("doc_id").cast("bigint"), F.col("source").cast("string"), F.col("text").cast("string"))
    both = staged(spread(rows).mapInArrow(_cut, "doc_id bigint, source string, keys array<bigint>, text string, n bigint"), "passages")
    distinct = both.where("text is not null").select(F.col("keys")[0].alias("key"), "text", "n").groupBy("key").agg(F.min("text").alias("text"), F.sum("n").alias("n"))

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [plain(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), batch.column(2), pa.array(["".join(["-0+"[v + 1] for v in votes(t)]) for t in texts], pa.string()), pa.array([features(t) for t in texts], pa.list_(pa.int32()))], names=["key", "text", "n", "votes", "at"])

    voted = staged(spread(distinct, "key").mapInArrow(vote, "key bigint, text string, n bigint, votes string, at array<int>"), "votes")
    return both.where("text is null").select("doc_id", "source", "keys"), voted


def _coded(text: str) -> list[int]:
    return ["-0+".index(c) - 1 for c in text]


def fit(voted: DataFrame, without: tuple[str, ...] = ()) -> tuple[LabelModel, np.ndarray]:
    """The label model over all passages, and the classifier's weights from the bounded sample.

    A passage's place in the sample is a hash of its text divided by how often the corpus has it: frequent passages come
    first, of rare ones a fixed random part. without: families of voters that are left out.
    """
    gone = [VOTERS.index(v) for family in without for v in FAMILIES[family]]
    counted = voted.groupBy("votes").agg(F.sum("n").alias("n")).orderBy("votes").collect()
    model = LabelModel(len(VOTERS))
    if not counted:
        return model, np.r_[np.zeros(SIZE - 1), -30.0]

    def coded(rows: list) -> np.ndarray:
        out = np.array([_coded(r["votes"]) for r in rows])
        out[:, gone] = 0
        return out

    model.fit(coded(counted), np.array([float(r["n"]) for r in counted]))
    place = F.pmod(F.xxhash64("text"), F.lit(1 << 40)) / F.col("n")
    positive = F.contains("votes", F.lit("+"))
    sample = []
    for which, most in ((positive, TRAIN_VOTED), (~positive, TRAIN_PLAIN)):
        sample += voted.where(which).orderBy(place, "text").limit(most).select("votes", "at").collect()
    rows, votes_of = [list(r["at"]) for r in sample], coded(sample)
    labels = model.posterior(votes_of)
    return model, train(rows, cross_fitted(rows, labels, (votes_of == 0).all(1)))


def passage_scores(voted: DataFrame, weights: np.ndarray) -> DataFrame:
    """(key, n, score) of every distinct passage."""
    shared = voted.sparkSession.sparkContext.broadcast(weights.astype(np.float32))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value.astype(float)
        for batch in batches:
            scores = np.round(probabilities(w, batch.column(2)), 6)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores, pa.float64())], names=["key", "n", "score"])

    return spread(voted.select("key", "n", "at")).mapInArrow(apply, "key bigint, n bigint, score double")


def scored(documents: DataFrame, without: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, source, score, n_passages, n_abusive) of every document.

    The passages' scores are joined back by key: the frequent ones, at most HOT, by broadcast, all others by a shuffle in
    which no key is frequent.
    """
    rows, voted = cut(documents)
    scores = staged(passage_scores(voted, fit(voted, without)[1]), "scores")
    total = int(scores.agg(F.sum("n")).first()[0] or 0)
    hot = scores.where(F.col("n") * HOT > total).select("key", "score")
    rest = scores.where(F.col("n") * HOT <= total).select("key", "score")
    # Repeated rows are documents of their own, so a row's own number keeps them apart.
    each = staged(rows.withColumn("row", F.monotonically_increasing_id()), "rows")
    cells = each.select("row", F.explode("keys").alias("key"))
    fast = cells.join(F.broadcast(hot), "key", "left")
    slow = fast.where("score is null").select("row", "key").join(rest, "key").select("row", "score")
    every = fast.where("score is not null").select("row", "score").unionByName(slow)
    by_row = every.groupBy("row").agg(F.max("score").alias("worst"), F.count_if(F.col("score") >= THRESHOLD).cast("int").alias("bad"))
    return each.join(by_row, "row", "left").select("doc_id", "source", F.coalesce("worst", F.lit(0.0)).alias("score"), F.size("keys").alias("n_passages"), F.coalesce("bad", F.lit(0)).alias("n_abusive"))


def scores(spark, sf_dir: str) -> DataFrame:
    return scored(load(spark, sf_dir, "documents"))


def found(spark, sf_dir: str) -> DataFrame:
    return scores(spark, sf_dir).where(F.col("score") >= THRESHOLD).select("doc_id")


def rates(spark, sf_dir: str) -> DataFrame:
    """Documents, found documents and their share per source."""
    hit = (F.col("score") >= THRESHOLD).cast("bigint")
    return scores(spark, sf_dir).groupBy("source").agg(F.count("*").alias("n_documents"), F.sum(hit).alias("n_found"), F.round(F.avg(hit), 6).alias("rate"), F.round(F.avg("score"), 6).alias("mean_score"))
