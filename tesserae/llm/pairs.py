"""Problem 3: defective prompt and response pairs.

Response openings (the first sentence but for an apology, numbers and names masked) are clustered by MinHash over
five-word shingles, verified at a Jaccard similarity of 0.8, by components. A band links its openings to two of them
only; the similar pairs left between clusters come from an exact prefix join over the shingles, rarest first, whose large
buckets are split into tiles, so the clusters are those of all similar pairs. A cluster is a refusal if it recurs across
unrelated prompts (as many as the least of four MinHashes of the prompts tells apart), the answer is little more than
the opening, the words stay the same (the cluster has a good share of all openings that begin with its first three words,
while an answer filled in from a pattern goes on differently each time), and they say little of the prompt. Where a
cluster can't tell, for too few prompts or too few words, a list of phrases does. Copy, language and termination checks
label the other defects; the termination check compares the last words with how often these words end a sentence, line
or item over all answers; a name at the end must be a known name, or else no beginning of one and end as names end.

One defect at most, the first of: empty, copy, refusal, language, truncated.

Defined cases: a null question has no language and is never copied; blank answers, or ones with only punctuation,
citation marks or a word for a missing value, are empty; pairs saved under two ids are two rows; very long answers are
read whole; empty tables give no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesserae.plans.components import components
from tesserae.plans.stage import materialize, small

#: Unrelated prompts from which on an opening counts as a template.
TEMPLATE_PROMPTS = 3
#: Own words a template must have: shorter answers recur whatever they say.
TEMPLATE_WORDS = 4
#: Share of a template among the openings with its first three words, and of its words found in the prompt.
FIXED_SHARE, ECHO_SHARE = 0.25, 0.5
#: Openings of a bucket that are compared in one task; larger buckets are split into tiles.
SPLIT = 4096
#: Functions that tell prompts apart.
PROMPT_HASHES = 4
#: Share of a word as a name of its own, among the names it begins, from which it is whole.
NAME_SHARE = 0.02
#: Share of two letters at the end of names, among all places in names, from which they are an ending.
END_SHARE = 0.1
#: Words that stand for a missing value.
MISSING = {"none", "null", "nan", "nil", "n a", "n d", "nd", "na", "undefined", "missing", "empty", "vuoto", "nessuna risposta", "no answer"}
#: Frequent words that tell the languages apart.
FUNCTION_WORDS = {
    "it": "il lo la gli le di del dello della dei degli delle da dal dalla al allo alla ai agli alle nel nella nei nelle con su sul sulla per tra fra che è e non si un uno una come quando dove quali quale quanti cosa chi perché se sono ha in dopo senza più questo questa oppure mi ti posso indica serve va l un d dell all nell dall sull qual".split(),
    "en": "the of and to in is are for with without on at by from this that which what how who why where do does did it its be as an or not into after before each under until near between i if no can which has have there".split(),
    "fr": "le la les des du de un une et est dans pour avec sans sur au aux par que qui où pourquoi comment ce cette il elle ne pas ou se sont après avant chaque sous entre jusqu je puis à selon en l d".split(),
    "de": "der die das den dem des ein eine einen einer und ist sind in im mit ohne auf für von vom zu zur zum nicht wo wie warum wer was ich nach vor bei an am aus oder sich bis unter zwischen jede jeder wird als es".split(),
    "es": "el la los las de del un una y es en con sin por para que qué cómo dónde quién al se no o su son después antes cada bajo entre hasta según sobre como lo hay este esta".split(),
}
#: Names of the languages in the five languages.
LANGUAGE_NAMES = {
    "it": r"italian[oa]?|italien(?:ne)?|italienisch|italiano",
    "en": r"ingles[ei]?|english|anglais|englisch|inglés",
    "fr": r"frances[ei]?|french|français|französisch|francés",
    "de": r"tedesc[oa]|german|allemand|deutsch|alemán",
    "es": r"spagnol[oa]|spanish|espagnol|spanisch|español|castellano",
}
#: What an opening says that declines, has no information or reports a failure.
REFUSALS = re.compile(
    r"""
    \bnon\ (?:ho|abbiamo|dispongo\ di|possiedo|trovo|ho\ trovato|ci\ sono|risultano|sono\ disponibili)\ (?:\w+\ ){0,3}?(?:informazion|dati\b|element|riferiment|rispost|indicazion|null|abbastanza|risult)
    |\bnon\ (?:(?:mi|ci)\ è\ possibile|è\ possibile|posso|possiamo|riesco\ a|sono\ in\ grado\ di|saprei|so|sono\ autorizzat\w\ a)\ (?:\w+\ ){0,2}?(?:aiutar|risponder|fornir|dir\w*\b|dar\w*\b|esprim|assister|soddisfar|trovar|elaborar|procedere|completar)
    |\bpreferisco\ non\b
    |\b(?:contesto|document\w+|materiale|font[ei]|manuale|archivio|testo|pagine|base\ dati)\b[^.;:]{0,50}?\bnon\ (?:contien|conteng|tratt|riport|rispond|includ|permett|fornisc|coprono|copre|menzion|c'è)
    |\bnon\ c'è\ nulla\b|\b(?:tacciono|tace)\b|\bmi\ fermo\ qui\b|\bnon\ (?:può|possono)\ essere\ (?:evas|soddisfatt|elaborat|complet|accolt)|\besula(?:no)?\ da
    |\b(?:si\ è\ verificato|è\ stato\ riscontrato|c'è\ stato)\ un\ (?:errore|problema)|\berrore\ (?:interno|durante|di\ sistema)|\b\w*(?:timeout|connect|value|runtime|key)error\b|\bservizio\ (?:non|temporaneamente)|\b(?:http|error[ei]?|codice)\ 5\d\d\b
    |\b(?:in\ quanto|essendo\ un|come)\ (?:assistente|modello|intelligenza)
    |\b(?:can'?t|can\ ?not|could\ not|unable\ to|not\ able\ to|am\ not\ allowed\ to)\ (?:\w+\ ){0,2}?(?:help|answer|assist|provide|give|respond|find|comment|say)
    |\b(?:do(?:es)?\ not|don't|doesn't)\ (?:have|contain|answer|cover|provide|include|mention)\b[^.]{0,40}(?:information|answer|question|data|topic|subject)
    |\bdo(?:es)?\ not\ (?:answer|cover)\b|\bas\ an?\ (?:virtual|ai|language|digital)\b|\b(?:an\ )?(?:internal\ )?error\ (?:occurred|has\ occurred|while|during)|\boutside\ (?:of\ )?my\b|\bprefer\ not\b|\brequest\ (?:cannot|could\ not)\b
    |\bje\ ne\ (?:peux|suis|sais|dispose|trouve)\b[^.]{0,12}\bpas\b|\bje\ n'ai\ pas\b|\bne\ (?:contien|répond|traite|permet)\w*\ pas\b|\bune\ erreur\b|\bassistant\ virtuel
    |\bkann\ ich\b[^.]{0,60}\bnicht\b|\bich\ kann\b[^.]{0,60}\bnicht\b|\bich\ habe\ (?:nicht\ genügend|keine|nicht\ genug)|\bnicht\ in\ der\ lage\b|\b(?:enthalten|enthält|beantworte[nt])\b[^.]{0,40}\b(?:keine|nicht)\b|\bein\ fehler\b|\bvirtueller\ assistent
    |\bno\ (?:puedo|podemos|me\ es\ posible|sé)\b|\bno\ (?:tengo|dispongo\ de|hay)\ (?:\w+\ ){0,2}?(?:información|datos|respuesta)|\bno\ (?:contien|respond|tratan?|incluy)\w*\b[^.]{0,30}(?:respuesta|pregunta|tema|información)|\b(?:ha\ ocurrido|se\ ha\ producido)\ un\ error|\basistente\ virtual
    """,
    re.X,
)
#: Sentences that only apologise; what they apologise for comes next.
APOLOGY = re.compile(r"\W*(?:(?:mi|ci)\ (?:dispiace|scuso)|scus[ai]|siamo\ spiacenti|spiacente|(?:i'?m|i\ am|we\ are)?\ ?(?:so\ |very\ )?sorry|my\ apologies|(?:je\ suis\ )?désolée?|(?:es\ )?tut\ mir\ leid|entschuldigung|lo\ siento(?:\ mucho)?|disculpe?|purtroppo\ no)\W*", re.X | re.I)
#: Beginnings that make what follows a case, not the answer's own statement.
CONDITIONS = re.compile(r"^\W*(?:se|quando|qualora|nel caso|when|if|in case|si|lorsque|quand|wenn|falls|cuando)\b(?! è verificato)")

_WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")
_PLAIN = re.compile(r"[^\W_]+")
_CITE = re.compile(r"\[\s*['\"]?\w{1,12}['\"]?\s*\]")
_URL_LINE = re.compile(r"^\s*(?:\[\s*['\"]?\w{1,12}['\"]?\s*\]\s*)+(?:https?://\S*)?\s*$")
_QUOTED = re.compile(r"\"[^\"]*\"|«[^»]*»|“[^”]*”")
_NOTHING = re.compile(r"[​‌‍⁠﻿\xad]")
_SENTENCE = re.compile(r"(?<=[.!?…])\s+|\n")
_NAMES = re.compile(r"#(?: (?:[^\W\d_]{1,3} )?#)+")  # a name of several words is one


def words_of(text: str) -> list[str]:
    return _PLAIN.findall(text.lower())


def is_empty(answer: str | None) -> bool:
    if answer is None:
        return True
    left = " ".join(words_of(_CITE.sub(" ", _NOTHING.sub("", answer))))
    return not left or left in MISSING


def is_copy(question: str | None, answer: str) -> bool:
    """Nothing but the question, once or more often, or after a label of up to four words and a colon."""
    q = words_of(question or "")
    if not q:
        return False

    def repeated(a: list[str]) -> bool:
        return len(a) >= len(q) and not len(a) % len(q) and a == q * (len(a) // len(q))

    plain = _CITE.sub(" ", answer)
    if repeated(words_of(plain)):
        return True
    label, colon, rest = plain.partition(":")
    return bool(colon) and len(words_of(label)) <= 4 and repeated(words_of(rest))


def language(text: str | None) -> str | None:
    """The language whose frequent words prevail, or None where too few tell."""
    if not text:
        return None
    tokens = [w for t in _WORD.findall(text.lower()) for w in re.split(r"['’]", t)]
    score = {code: sum(w in own for w in tokens) for code, own in _FUNCTION.items()}
    order = sorted(score, key=lambda c: (-score[c], c))
    best, next_ = score[order[0]], score[order[1]]
    return order[0] if best >= 2 and best >= 1.3 * next_ or best == 1 and not next_ and len(tokens) <= 6 else None


_FUNCTION = {k: set(v) for k, v in FUNCTION_WORDS.items()}
_ASKED = {k: re.compile(rf"\b(?:{v})\b", re.I) for k, v in LANGUAGE_NAMES.items()}


def is_foreign(question: str | None, answer: str) -> bool:
    asked, given = language(question), language(answer)
    return bool(asked and given and asked != given and not _ASKED[given].search(question or ""))


def opening(answer: str) -> str:
    """The first sentence but for an apology, without quotations and citations; numbers are 0 and names are #."""
    sentences = [s for s in _SENTENCE.split(_CITE.sub(" ", answer).strip()) if _PLAIN.search(s)]
    first = next((s for s in sentences if not APOLOGY.fullmatch(s)), sentences[0] if sentences else "")
    tokens = _WORD.findall(_QUOTED.sub(" ", first))
    return _NAMES.sub("#", " ".join("#" if i and t[0].isupper() else re.sub(r"\d+", "0", t.lower()) for i, t in enumerate(tokens)))


def own_words(opened: str) -> list[str]:
    """The words of an opening that aren't masked."""
    return [w for w in opened.split() if w not in ("#", "0")]


def echo(question: str | None, opened: str) -> float:
    """Share of an opening's words that stand in the question."""
    own, asked = own_words(opened), set(words_of(question or ""))
    return sum(w in asked for w in own) / len(own) if own else 0.0


def prompt_hashes(question: str | None) -> list[int]:
    """MinHashes of a question's pairs of words: related questions have equal ones, unrelated ones haven't."""
    import xxhash

    words = words_of(question or "")
    pairs = {f"{a} {b}" for a, b in zip(words, words[1:])} or set(words) or {""}
    return [min(xxhash.xxh64_intdigest(p, i) for p in pairs) - 2**63 for i in range(PROMPT_HASHES)]


def declines(first: str) -> bool:
    return bool(REFUSALS.search(first)) and not CONDITIONS.search(first)


def _mask(token: str) -> str:
    return "0" if token[0].isdigit() else "#" if token[0].isupper() else token.lower()


def ending(answer: str) -> tuple[str, str | None]:
    """complete, broken or open with the key of the last two words and the last name, which the table of endings decides."""
    lines = answer.rstrip().split("\n")
    while len(lines) > 1 and (not lines[-1].strip() or _URL_LINE.match(lines[-1])):
        last = lines.pop().strip()
        if "://" in last and not re.search(r"://[^/\s]+\.[a-z]{2,}/\S*[^\W_]$", last):
            return "broken", None
    text = "\n".join(lines).rstrip()
    tail = text.split("\n")[-1]
    if re.search(r"\[\s*['\"]?\w{0,12}$", tail) or re.search(r"https?:?/?/?\S*$", tail) and not re.search(r"https?://[^/\s]+\.[a-z]{2,}(?:/\S*)?$", tail):
        return "broken", None
    if any(tail.count(a) > tail.count(b) for a, b in ("()", "[]", "«»", "“”", "{}")) or tail.count('"') % 2:
        return "broken", None
    bare = _CITE.sub("", tail).rstrip() if re.search(r"\]\s*$", tail) else tail
    cited = bare != tail and not re.search(r"[^\W_]$", bare) is None
    if cited or not bare:
        return "complete", None
    if re.search(r"[,;:(\[–—-]$|[^\W_]['’]$", bare):
        return "broken", None
    if re.search(r"[.!?…»”\")\]*]$", bare):
        return "complete", None
    tokens = [(m.group(), m.start()) for m in _WORD.finditer(bare)]
    if not tokens:
        return "complete", None
    if len(tokens) == 1 or len(tokens) <= 3 and bare == answer.strip():
        return "complete", None
    last = tokens[-1][0]
    if last[0].isupper() and re.search(r",\s*$", bare[: tokens[-1][1]]):
        return "open", f"|{last}"
    return "open", f"{_mask(tokens[-2][0])} {_mask(last)}|{last if last[0].isupper() else ''}"


def _endings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of word pairs and of those that end a sentence or clause, of names (=) and of two letters in them (~)."""
    pairs: Counter = Counter()
    ends: Counter = Counter()
    for b in batches:
        for answer in b.column(0).to_pylist():
            for sentence in re.split(r"\n", _CITE.sub("", answer or "")):
                tokens = [(m.group(), m.end()) for m in _WORD.finditer(sentence)]
                for (x, _), (y, at) in zip(tokens, tokens[1:]):
                    key = f"{_mask(x)} {_mask(y)}"
                    pairs[key] += 1
                    ends[key] += sentence[at : at + 1] in (".", "!", "?", ";") and not sentence[at + 1 : at + 2].isalnum()
                for x, _ in tokens[:-1]:
                    if x[0].isupper():
                        pairs["=" + x] += 1
        if len(pairs) > 400_000:
            yield _endings_batch(pairs, ends)
            pairs, ends = Counter(), Counter()
    yield _endings_batch(pairs, ends)


def _endings_batch(pairs: Counter, ends: Counter) -> pa.RecordBatch:
    for name, n in [(k[1:].lower(), n) for k, n in pairs.items() if k[0] == "="]:
        for i in range(max(1, len(name) - 1)):
            pairs["~" + name[i : i + 2]] += n
        ends["~" + name[-2:]] += n
    keys = list(pairs)
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([pairs[k] for k in keys], pa.int64()), pa.array([ends[k] for k in keys], pa.int64())], names=["key", "n", "n_end"])


_LOOKED = pa.schema([
    ("other", pa.string()), ("opening", pa.string()), ("whole", pa.bool_()), ("echo", pa.float64()), ("hashes", pa.list_(pa.int64())), ("last_pair", pa.string()), ("last_word", pa.string()),
])


def _look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for q, a in zip(b.column("question").to_pylist(), b.column("answer").to_pylist()):
            if is_empty(a):
                rows.append(("empty", *[None] * 6))
            elif is_copy(q, a):
                rows.append(("copy", *[None] * 6))
            else:
                state, key = ending(a)
                other = "language" if is_foreign(q, a) else "truncated" if state == "broken" else None
                first = opening(a)
                whole = len(words_of(a)) <= 2 * len(first.split()) + 4
                rows.append((other, first, whole, echo(q, first), prompt_hashes(q) if whole else None, *(key.split("|") if key else (None, None))))
        cols = [pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * 7, _LOOKED)]
        yield pa.RecordBatch.from_arrays([b.column("id"), b.column("prompt"), *cols], names=["id", "prompt", *_LOOKED.names])


def shingles(text: str, n: int = 5) -> list[str]:
    w = text.split()
    return sorted({" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))})


def _bands(bands: int = 8, rows: int = 2):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for b in batches:
            out: dict[str, list] = {"opening": [], "band": []}
            for text in b.column(0).to_pylist():
                sh = shingles(text)
                mins = [min(xxhash.xxh64_intdigest(s, i) for s in sh) for i in range(bands * rows)]
                for i in range(bands):
                    out["opening"].append(text)
                    out["band"].append(xxhash.xxh64_intdigest(repr((i, mins[i * rows : i * rows + rows]))) - 2**63)
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("opening", pa.string()), ("band", pa.int64())]))

    return run


def _jaccard(a: str, b: str) -> float:
    x, y = set(shingles(a)), set(shingles(b))
    return len(x & y) / len(x | y)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keep = [_jaccard(x, y) >= 0.8 for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
        yield b.filter(pa.array(keep, pa.bool_()))


def _shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import xxhash

    for b in batches:
        rows = [list({xxhash.xxh64_intdigest(s) - 2**63 for s in shingles(text)}) for text in b.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(rows, pa.list_(pa.int64()))], names=[*b.schema.names, "shingles"])


def similar_openings(clusters: DataFrame, split: int = SPLIT) -> DataFrame:
    """opening, first: all pairs of ``clusters`` (opening, cluster) with a similarity of 0.8 and different clusters.

    Two such sets of m and n shingles have 4/5 of the larger one in common, so the first common one is among the first
    m - 4/5 m + 1 of each, in any order; rarer ones come first. A bucket of more than ``split`` openings is spread over
    groups, and every pair of groups is a tile.
    """
    sets = clusters.mapInArrow(_shingled, "opening string, cluster string, shingles array<long>")
    sets = sets.select(F.xxhash64("opening").alias("key"), F.xxhash64("cluster").alias("own"), F.size("shingles").alias("size"), F.explode("shingles").alias("shingle"))
    sets = materialize(sets, "shingles")
    times = sets.groupBy("shingle").agg(F.count("*").alias("times"))
    place = F.row_number().over(Window.partitionBy("key").orderBy("times", "shingle"))
    first = sets.join(times, "shingle").withColumn("left", F.col("size") - place + 1)
    first = first.where("times > 1 and left >= ceil(4 * size / 5)").select("shingle", "key", "own", "size", "left")
    first = materialize(first, "prefixes")
    buckets = first.groupBy("shingle").agg(F.ceil(F.count("*") / split).alias("groups"), F.min("own").alias("least"), F.max("own").alias("most"))
    tiles = first.join(buckets.where("least < most").drop("least", "most"), "shingle").withColumn("mine", F.expr("pmod(xxhash64(key), groups)"))
    tiles = tiles.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)))
    tiles = tiles.select("shingle", F.least("mine", "other").alias("low"), F.greatest("mine", "other").alias("high"), "mine", "key", "own", "size", "left")
    a, b = (tiles.select("shingle", "low", "high", *[F.col(c).alias(f"{c}_{x}") for c in ("mine", "key", "own", "size", "left")]) for x in "ab")
    met = a.join(b, ["shingle", "low", "high"]).where("key_a < key_b and own_a <> own_b and (low = high or mine_a <> mine_b)")
    met = met.where("5 * least(size_a, size_b) >= 4 * greatest(size_a, size_b) and 9 * least(left_a, left_b) >= 4 * (size_a + size_b)")
    met = materialize(met.select("key_a", "key_b").distinct(), "met")
    a, b = (clusters.select(F.xxhash64("opening").alias(f"key_{x}"), F.col("opening").alias(to)) for x, to in (("a", "opening"), ("b", "first")))
    return met.join(a, "key_a").join(b, "key_b").select("opening", "first").mapInArrow(_verify, "opening string, first string")


def _clustered(openings: DataFrame, links: DataFrame) -> DataFrame:
    if not links.limit(1).count():
        return openings.withColumn("cluster", F.col("opening"))
    joined = components(links, "opening", "first")
    return openings.join(joined, openings["opening"] == joined["node"], "left").select(*openings.columns, F.coalesce("component", "opening").alias("cluster"))


def opening_clusters(openings: DataFrame, split: int = SPLIT) -> DataFrame:
    """opening, cluster: components of all similar pairs of ``openings`` (distinct).

    Those that a band's least or greatest opening verifies come first, so that only pairs between their clusters are left.
    """
    banded = materialize(openings.select("opening").mapInArrow(_bands(), "opening string, band long"), "bands")
    ends = banded.groupBy("band").agg(F.min("opening").alias("least"), F.max("opening").alias("most")).where("least < most")
    links = banded.join(ends, "band").select("opening", F.explode(F.array("least", "most")).alias("first")).where("opening <> first").distinct()
    links = materialize(links.mapInArrow(_verify, "opening string, first string"), "links")
    clusters = materialize(_clustered(openings.select("opening"), links), "clusters")
    rest = materialize(similar_openings(clusters, split), "rest")
    return _clustered(openings, links.unionByName(rest))


def _refusing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        openings = b.column(0).to_pylist()
        words = pa.array([len(own_words(x)) for x in openings], pa.int32())
        yield b.append_column("words", words).append_column("declines", pa.array([declines(x) for x in openings], pa.bool_()))


def label_pairs(pairs: DataFrame, template_prompts: int = TEMPLATE_PROMPTS, phrases: bool = True) -> DataFrame:
    """id, defect of every defective row of ``pairs`` (id, question, answer); ``phrases``: whether the list decides rare openings."""
    rows = pairs.select("id", "question", "answer", F.xxhash64("question").alias("prompt"))
    looked = rows.mapInArrow(_look, "id long, prompt long, other string, opening string, whole boolean, echo double, hashes array<long>, last_pair string, last_word string")
    looked = materialize(looked, "pairs")
    said = looked.where("opening is not null").groupBy("opening", "prompt").agg(F.sum("echo").alias("echo"), F.count("*").alias("n"), F.max("whole").alias("whole"))
    said = said.groupBy("opening").agg(F.count("*").alias("prompts"), F.count_if("whole").alias("whole"), F.sum("echo").alias("echo"), F.sum("n").alias("n"))
    said = materialize(opening_clusters(materialize(said.where("opening <> ''"), "said")), "openings")
    begin = F.substring_index("opening", " ", 3)
    begun = said.groupBy(begin.alias("begin")).agg(F.sum("prompts").alias("begun"))
    met = looked.where("whole and opening <> ''").select("opening", F.posexplode("hashes").alias("i", "hash")).distinct()
    apart = met.join(said.select("opening", "cluster"), "opening").select("cluster", "i", "hash").distinct().groupBy("cluster", "i").agg(F.count("*").alias("n"))
    apart = apart.groupBy("cluster").agg(F.min("n").alias("unrelated"))
    told = said.groupBy("cluster").agg(F.sum("whole").alias("size"), (F.sum("echo") / F.sum("n")).alias("echo")).join(apart, "cluster")
    told = said.select("opening", "cluster", begin.alias("begin")).join(begun, "begin").join(told, "cluster").drop("cluster", "begin")
    told = told.mapInArrow(_refusing, "opening string, begun long, size long, echo double, unrelated long, words int, declines boolean")
    recurs = (F.col("unrelated") >= template_prompts) & (F.col("words") >= TEMPLATE_WORDS)
    fixed = (F.col("size") >= FIXED_SHARE * F.greatest("size", "begun")) & (F.col("echo") < ECHO_SHARE)
    told = told.where(F.when(recurs, fixed).otherwise(F.col("declines") & F.lit(phrases)))
    told = materialize(told.select("opening", F.lit(True).alias("template")), "refusals")
    endings = pairs.select("answer").mapInArrow(_endings, "key string, n long, n_end long").groupBy("key").agg(F.sum("n").alias("n"), F.sum("n_end").alias("n_end"))
    endings = materialize(endings, "endings")
    open_ = looked.where("last_pair is not null").select("id", F.col("last_pair").alias("key"), "last_word", F.concat(F.lit("~"), F.lower(F.right("last_word", F.lit(2)))).alias("letters"))
    names = endings.where(F.col("key").startswith("=")).select(F.substring("key", 2, 1 << 30).alias("last_word"), F.col("n").alias("n_name"))
    lasts = open_.select("last_word").where("last_word <> ''").distinct()
    starts = names.where(F.length("last_word") > 1).select(F.explode(F.expr("transform(sequence(1, length(last_word) - 1), i -> left(last_word, i))")).alias("last_word"), "n_name")
    starts = starts.join(lasts, "last_word", "left_semi").groupBy("last_word").agg(F.sum("n_name").alias("n_start"))
    judged = open_.join(endings, "key", "left").join(endings.select(F.col("key").alias("letters"), F.col("n").alias("n_letters"), F.col("n_end").alias("n_last")), "letters", "left")
    judged = judged.join(names, "last_word", "left").join(starts, "last_word", "left")
    stops = (F.col("key") == "") | F.coalesce((F.col("n_end") > 0) & (F.col("n_end") >= 0.02 * F.col("n")), F.lit(False))
    known = F.col("n_name").isNotNull() & (F.col("n_name") >= NAME_SHARE * F.coalesce("n_start", F.lit(0)))
    ends = F.coalesce((F.col("n_last") > 0) & (F.col("n_last") >= END_SHARE * F.col("n_letters")), F.lit(False))
    whole = (F.col("last_word") == "") | F.when(F.col("n_name").isNotNull() | F.col("n_start").isNotNull(), known).otherwise(ends)
    broken = judged.where(~(stops & whole))
    rows = looked.join(small(told.select("opening", "template")), "opening", "left").join(broken.select("id", F.lit(True).alias("broken")), "id", "left")
    refusal = F.col("template").isNotNull() & F.coalesce("whole", F.lit(False))
    defect = (
        F.when(F.col("other").isin("empty", "copy"), F.col("other")).when(refusal, "refusal").when(F.col("other").isNotNull(), F.col("other")).when(F.col("broken"), "truncated")
    )
    return rows.select("id", defect.alias("defect")).where("defect is not null")
