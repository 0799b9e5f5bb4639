"""The training-data operators against brute force, round trips and edge cases."""

import random
import re
from statistics import NormalDist

import pytest
from pyspark.sql import functions as F

from tesserae.llm import lines, mixing, neardup, pairs, ranking, scans, spans, split, tokens

CHUNK = "chunk_id string, source string, content_type string, content string, fetched_at timestamp, chunk_index int, headers_context array<string>, site string, line string"


def chunk_frame(spark, rows):
    full = [(r[0], r[1], r[2], r[3], None, i, ["h"], "clash", "clash") for i, r in enumerate(rows)]
    return spark.createDataFrame(full, CHUNK)


# ---- 1: scans


def test_scan_parts():
    assert scans.is_page_number("— 12 —") and scans.is_page_number("Pag. 3 di 40") and scans.is_page_number("[7]") and scans.is_page_number("9 |")
    assert not any(map(scans.is_page_number, ["1963-2008", "2018).", "US44", "3D", "-", "", "46758)", "1.", "12,5"]))
    assert scans.title_of("Quaderni  da  Monte  12") == ("quaderni da monte", True) and scans.title_of("QUADERNI DA MONTE") == ("quaderni da monte", False)
    assert scans.title_of("fine della frase.") is None and scans.title_of("") is None
    assert scans.reading_cost("mosfra", "mostra") == pytest.approx((0.3, 1)) and scans.reading_cost("aggioma", "aggiorna") == pytest.approx((0.3, 1))
    assert scans.reading_cost("casa", "casa") == (0, 0)


def scan_rows():
    words = "mostra numero livello catalogo materiali raccolti potenziale scheda comune terreno documenta quota poligono relazione geologica del della nel settore".split()
    rng = random.Random(3)
    clean = [(f"t{i}", f"s{i % 3}", "text", " ".join(rng.choice(words) for _ in range(60)) + ".") for i in range(120)]
    body = "Il catalogo mostra la quota del\nterreno nel settore della scheda."
    pages = [(f"p{i}", "vol", "image_ocr", f"Quaderni da Monte\n{body}\n{i + 3}") for i in range(4)]
    pages += [("h", "vol", "image_ocr", "Il catalogo mostra la quota del ter-\nreno nel settore."), ("c", "vol", "image_ocr", "Il catalogo mosfra la quota del terreno.")]
    pages += [("ok", "vol", "image_ocr", body), ("n", None, "image_ocr", None), ("e", "vol", "image_ocr", ""), ("d", "vol", "image_ocr", "anni 1963-\n2008 del comune")]
    return clean + pages + pages[:2]


def test_scans(spark):
    frame = chunk_frame(spark, scan_rows())
    got = {(r.chunk_id, r.noise) for r in scans.noise_rows(frame).collect()}
    assert got == {(f"p{i}", k) for i in range(4) for k in ("header", "page_no")} | {("h", "hyphen"), ("c", "char")}
    text = {r.chunk_id: r.content for r in scans.repaired(frame).collect()}
    assert text["h"] == "Il catalogo mostra la quota del terreno nel settore." and text["c"] == "Il catalogo mostra la quota del terreno."
    assert text["p1"] == "Il catalogo mostra la quota del terreno nel settore della scheda." and "\n" in text["ok"] and text["e"] == "" and text["n"] is None


def test_scans_learn_from_every_word(spark, monkeypatch):
    """The contrast and the classifiers rest on all rare clean words, more than 2,000, not on a part of them."""
    rng = random.Random(4)
    rare = {"".join(rng.choice("bcdfg") + rng.choice("aeiou") for _ in range(5)) for _ in range(2600)}
    often = sorted(rare)[::40]
    rare = sorted({w[:i] + c + w[i + 1 :] for w in often for i in range(10) for c in "lmnr"} - set(often))
    rows = [("o", "s", "text", " ".join(often * 20)), *[(f"r{i}", "s", "text", f"{w}.") for i, w in enumerate(rare)]]
    seen = {}
    learn, fit = scans.usual_confusions, scans._fitted

    def learned(near, near_clean):
        seen["contrast"] = near_clean.select("read").distinct().count()
        return learn(near, near_clean)

    def fitted(rows, cuts, label, trees):
        seen[label] = rows.agg(F.sum("w")).first()[0]
        return fit(rows, cuts, label, trees)

    monkeypatch.setattr(scans, "usual_confusions", learned)
    monkeypatch.setattr(scans, "_fitted", fitted, raising=False)
    scans.noise_rows(chunk_frame(spark, rows)).count()
    assert len(rare) > 2000 and seen["contrast"] == len(rare)
    assert seen["divided"] > 2 * len(rare) and seen["replacements"] > len(rare)


def test_candidates_leave_a_task_only_as_pairs(spark, monkeypatch):
    """In any number of blocks the candidates are those of brute force, and no row for a mere common gram is made."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("aeilmnr") for _ in range(rng.randint(3, 9)))
    known = {word(): k for k in range(300)} | {"eh": 9}
    reads = sorted({word() for _ in range(80)} | {"ai"})
    want = set()
    for r in reads:
        for w in known:
            common = len(scans.grams(r) & scans.grams(w))
            if scans.is_candidate(r, w, common):
                want.add((r, w, common, known[w], len(r), w[0] == r[0], True))
    own = spark.createDataFrame([(r, len(r), [w for w in known if w[0] == r[0]]) for r in reads], "read string, n_clean long, targets array<string>")
    table = spark.createDataFrame(list(known.items()), "word string, n long")
    for most in (100_000, 70):
        monkeypatch.setattr(scans, "READS", most // 10)
        monkeypatch.setattr(scans, "KNOWN_MOST", most)
        found = scans._candidates(own, table)
        got = [tuple(r) for r in found.collect()]
        assert len(got) == len(set(got)) and set(got) == want
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan and "HashAggregate" not in plan


def test_features_of_many_pairs():
    """Features reckoned for all pairs at once are those of each pair, also where nothing is usual or costs end the search."""
    import numpy as np

    rng = random.Random(7)
    word = lambda: "".join(rng.choice("aeilmnrcdu1]") for _ in range(rng.randint(1, 13)))
    pairs_ = [(word(), word()) for _ in range(300)] + [(w, w) for w in ("casa", "a")] + [("mosfra", "mostra"), ("aggioma", "aggiorna")]
    read, true, counts = [a for a, _ in pairs_], [b for _, b in pairs_], [rng.randint(0, 50) for _ in pairs_]
    for usual in (scans.CONFUSIONS, [("rn", "m"), ("c", "ab")], []):
        cheap = scans.by_reading(usual)
        got = scans.replacement_table(read, true, counts, counts[::-1], counts, cheap)
        want = [scans.replacement_features(r, t, c, n, c, cheap) for r, t, c, n in zip(read, true, counts, counts[::-1])]
        assert np.array_equal(got, np.array(want, float))


@pytest.mark.parametrize("limit", [1000, 0])
def test_trees_of_a_table(spark, limit):
    """Trees grown from sums, on the driver or by jobs, are those of the rows in memory, weights counting as copies."""
    import numpy as np

    from tesserae.llm.boost import Boosted, binned

    rng = np.random.RandomState(2)
    x = rng.randint(0, 6, (400, 3)).astype(float)
    y = (x[:, 0] + x[:, 1] > 5).astype(float)
    cuts = [[0.0, 1.0, 2.0, 3.0, 4.0]] * 3
    counts: dict = {}
    for a, b in zip(x, y):
        counts[binned(a, cuts), b] = counts.get((binned(a, cuts), b), 0) + 1
    table = spark.createDataFrame([(bytearray(k), float(b), float(n)) for (k, b), n in counts.items()], "bins binary, y double, w double")
    got = Boosted(trees=4).fit_table(table, cuts, limit).predict(x)
    want = Boosted(trees=4, bins=400).fit(x, y).predict(x)
    assert np.allclose(got, want, atol=1e-6)


def test_scans_of_nothing(spark):
    assert scans.noise_rows(chunk_frame(spark, [])).count() == 0


def test_replacement_model_on_held_out_words():
    rng = random.Random(1)
    words = {"".join(rng.choice("aeioulmnrstcdpv") for _ in range(rng.randint(5, 10))): 50 for _ in range(400)}
    model = scans.train_replacements(words, [("zzkqx", 1)])
    import numpy as np

    state, right, n = np.random.RandomState(99), 0, 0
    for w in list(words)[:200]:
        read = scans.spoil(w, state)
        if read and read not in words:
            near = [(v, len(scans.grams(read) & scans.grams(v))) for v in words]
            near = [(v, c) for v, c in near if scans.is_candidate(read, v, c)]
            if near:
                p = model.predict(np.array([scans.replacement_features(read, v, c, 50, 0) for v, c in near]))
                right, n = right + (near[int(p.argmax())][0] == w), n + 1
    assert n > 100 and right / n > 0.95


# ---- 2: repeated lines


def brute_lines(rows, threshold):
    seen, all_ = {}, []
    for key, source, kind, content in rows:
        if key and source and content is not None and kind != "image_ocr":
            host = re.sub(r"^www\.", "", re.match(r"(?:https?://)?([^/:]*)", source.lower())[1])
            for i, raw in enumerate(content.split("\n"), 1):
                norm = re.sub(r"\d+", "0", " ".join(raw.lower().split()))
                if re.search(r"[^\W\d_]", norm):
                    seen.setdefault((host, norm), set()).add(source)
                    all_.append((key, i, host, norm))
    return {(k, i) for k, i, h, n in all_ if len(seen[h, n]) >= threshold}


def line_cases():
    rows = [(f"c{i}", f"https://{'www.' * (i % 2)}A.example{':443' * (i % 3 == 0)}/p{i}", "text", f"Testo {'abcdefgh'[i]} vario\n  Visite:  {i * 7}\n---") for i in range(8)]
    rows += [("x", "https://a.example/p0", None, "visite: 3\nvisite: 4"), ("y", "https://b.example/q", "text", "visite: 1"), ("z", None, "text", "visite: 1")]
    return rows + [("o", "https://a.example/p99", "image_ocr", "visite: 1"), ("n", "https://a.example/n", "text", None), ("e", "https://a.example/e", "text", "")] + rows[:1]


@pytest.mark.parametrize("parts", [1, 3])
def test_lines(spark, parts):
    rows = line_cases()
    frame = chunk_frame(spark, rows).withColumn("fetched_at", F.expr("timestamp_seconds(cast(hash(chunk_id) % 1000 as bigint))"))
    found = lines.repeated_lines(frame, 5, parts)
    got = {(r.chunk_id, r.line_no) for r in found.collect()}
    assert got == brute_lines(rows, 5) and ("x", 2) in got
    clean = {r.chunk_id: r.content for r in lines.clean_chunks(frame, 5, parts).collect()}
    assert clean == {r.chunk_id: r.content for r in lines.without_lines(frame, found).collect()}
    assert clean["c1"] == "Testo b vario\n---" and clean["x"] == ""


def test_lines_merged_by_another_session(spark, tmp_path):
    rows = line_cases()[:-1]  # no row twice
    frames = [chunk_frame(spark, rows[i::3]) for i in range(3)]
    folder, found = f"file://{tmp_path}/counts", set()
    for i, part in enumerate(frames):
        session = spark.newSession()
        state = lines.LineCounts(session, folder, 5)
        assert state.version() == i
        removed = state.merge(part)
        rebuilt = {r.chunk_id for r in state.rebuilt(chunk_frame(spark, rows), removed).collect()}
        now = {(r.chunk_id, r.line_no) for r in removed.collect()}
        assert rebuilt == {k for k, _ in now} and not (now & found)
        found |= now
    assert found == brute_lines(rows, 5)
    assert lines.LineCounts(spark, folder, 5).merge(frames[0]).join(frames[0], "chunk_id", "left_anti").count() == 0


# ---- 3: pairs


def test_pair_checks():
    assert all(map(pairs.is_empty, [None, "", " \n", "…", "[1] [2].", "n/a", "None", "​"])) and not pairs.is_empty("No.")
    assert pairs.is_copy("Dove trovo la scheda?", "DOVE  TROVO la scheda... dove trovo la scheda") and pairs.is_copy("Chi è?", "Domanda: chi è")
    assert not pairs.is_copy("Chi è?", "Chi è? Mario.") and not pairs.is_copy(None, "x")
    assert pairs.is_foreign("Dove trovo la scheda di sito?", "The site record is in the list of finds.")
    assert not pairs.is_foreign("Dove trovo la scheda? Rispondi in inglese.", "The site record is in the list of finds.")
    assert pairs.declines(pairs.opening("Mi dispiace, non posso aiutarti con questa richiesta.")) and pairs.declines(pairs.opening("I do not have enough information."))
    assert not pairs.declines(pairs.opening('Se il sistema mostra "Si è verificato un errore", basta salvare.'))
    assert pairs.ending("La scheda (Roma, n.")[0] == "broken" and pairs.ending("Fatto [1].")[0] == "complete" and pairs.ending("il campo di")[0] in ("open", "complete")


def test_pairs(spark):
    rows = [(i, f"Dove trovo il numero {i} della scheda?", f"Il modulo della scheda contiene il numero {i} nel settore.") for i in range(40)]
    rows += [(100, "Chi è il responsabile?", None), (101, "Chi è il responsabile?", "Non ho informazioni sufficienti."), (102, "Dove è la scheda?", "Non ho informazioni sufficienti.")]
    rows += [(103, "Quando serve il modulo?", "Non ho informazioni sufficienti."), (104, "Dove è il modulo?", "Il modulo della scheda contiene il numero 4 nel"), (105, None, "Il modulo è qui.")]
    got = {r.id: r.defect for r in pairs.label_pairs(spark.createDataFrame(rows, "id long, question string, answer string")).collect()}
    assert got == {100: "empty", 101: "refusal", 102: "refusal", 103: "refusal", 104: "truncated"}


PROMPTS = ["Dove si trova la scheda di sito?", "Chi compila il modulo?", "Quando scade la consegna degli elaborati?", "Quale formato serve per le foto?", "Perché la topologia dà errore?"]


def test_refusals_by_cluster(spark):
    """A cluster takes in its members; an apology isn't the whole opening; a rare refusal is known by its phrase."""
    head = "per la domanda che è stata posta in questa sede sulla planimetria di dettaglio e sul relativo allegato di campo compilato a mano dal nostro gruppo di lavoro durante la campagna di scavo"
    rows = [(i, q, f"{head} non posso rispondere.") for i, q in enumerate(PROMPTS)]
    rows += [(10, "Chi firma il verbale?", f"{head} non posso replicare."), (11, "Chi compila la scheda?", "Mi dispiace. Non posso rispondere."), (12, "Quando serve?", "Mi dispiace. Il modulo è nella scheda.")]
    got = {r.id: r.defect for r in pairs.label_pairs(spark.createDataFrame(rows, "id long, question string, answer string")).collect()}
    assert got == {i: "refusal" for i in (0, 1, 2, 3, 4, 10, 11)}


def test_refusals_without_phrases(spark):
    """What recurs under unrelated prompts is a refusal, unless it is filled in, short, the prompt's own words, or the prompts are related."""
    rows = [(i, q, "Resto in silenzio su tale faccenda.") for i, q in enumerate(PROMPTS)]
    rows += [(10 + 8 * i + j, f"{q} Caso {j}", f"Basta aprire il pannello {'ab ac ad ae af ag ah ai'.split()[j]} e salvare.") for i, q in enumerate(PROMPTS) for j in range(8)]
    rows += [(100 + i, q, "Sì, certo.") for i, q in enumerate(PROMPTS)]
    rows += [(200 + i, f"Il rilievo del pozzo numero {i} è già finito?", "Lavoro in pausa fino a domani sera.") for i in range(6)]
    rows += [(300 + i, f"{q} Il fosso a nord va chiuso?", "Il fosso a nord va chiuso.") for i, q in enumerate(PROMPTS)]
    found = pairs.label_pairs(spark.createDataFrame(rows, "id long, question string, answer string"), phrases=False)
    got = {r.id for r in found.where("defect = 'refusal'").collect()}
    assert got == set(range(5))


@pytest.mark.parametrize("split", [4096, 5])
def test_clusters_are_those_of_all_similar_openings(spark, split):
    """Bands full of openings that are not similar enough to each other, two and two of which are."""
    base = [f"parola{i}" for i in range(50)]
    texts = [" ".join([*base[:at], f"altro{at}{x}", *base[at + 1 :]]) for at in range(5, 45) for x in "ab"] + ["una frase breve", "una frase", "sola"]
    parent = {t: t for t in texts}
    for i, a in enumerate(texts):
        for b in texts[:i]:
            if pairs._jaccard(a, b) >= 0.8:
                old, new = parent[a], parent[b]
                parent = {t: new if c == old else c for t, c in parent.items()}
    want = {frozenset(t for t in texts if parent[t] == c) for c in set(parent.values())}
    rows = pairs.opening_clusters(spark.createDataFrame([(t,) for t in texts], "opening string"), split=split).collect()
    got: dict[str, set[str]] = {}
    for r in rows:
        got.setdefault(r.cluster, set()).add(r.opening)
    assert len(rows) == len(texts) and len(want) == 43 and set(map(frozenset, got.values())) == want


@pytest.mark.parametrize("times", [1, 20])
def test_pairs_broken_in_a_name(spark, times):
    """Stumps of known names are truncated, however often their last letters end other names; known and new names aren't."""
    names = ["Valmorto", "Galtino", "Sanvena", "Ostal", "Perugal", "Arborsan", "Termisan", "Lunival", "Cortival", "Tivoli"]
    rows = [(i, f"Dove si trova il punto {i}?", f"Il punto si trova presso {names[i % 10]} da anni.\nIl saggio dista molto da {names[i % 10]}.") for i in range(40 * times)]
    ends = {"Val": True, "Gal": True, "San": True, "Perug": True, "Tivoli": False, "Lunival": False, "Mortino": False}
    rows += [(10_000 + i, f"Dove si trova lo scavo {i}?", f"Lo scavo dista molto da {w}") for i, w in enumerate(ends)]
    got = {r.id: r.defect for r in pairs.label_pairs(spark.createDataFrame(rows, "id long, question string, answer string")).collect()}
    assert got == {10_000 + i: "truncated" for i, broken in enumerate(ends.values()) if broken}


# ---- 4: splitting


def texts():
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(rng.randint(1, 12)))
    plain = [" ".join(word() + rng.choice(["", "", ".", ",", "\n"]) for _ in range(n)) for n in (1, 60, 200, 900)]
    return [*plain, "", " " * 700, "x" * 2000, "aa " * 10 + "y" * 600 + " fine.", "é́😀 " * 300, "parola " * 73 + "a"]


def test_cuts_cover_and_keep_the_limits():
    for limit, overlap in ((512, 128), (40, 10), (5, 0)):
        for text, (starts, ends, unbroken) in zip(texts(), split.cuts(texts(), limit, overlap)):
            assert starts[0] == 0 and ends[-1] == len(text) and unbroken == bool(re.search(rf"\S{{{limit + 1}}}", text))
            assert all(e - s <= limit for s, e in zip(starts, ends))
            for s, e in zip(starts[1:], ends[:-1]):
                assert s <= e <= s + overlap
            for s, e in zip(starts, ends[:-1]):
                if re.search(r"\s\S", text[s : e + limit - (e - s)][1:]):
                    assert text[e - 1].isspace() and not text[e].isspace()


def test_split_items(spark):
    rows = [(f"k{i}", "s" if i % 3 else None, "text", t) for i, t in enumerate(texts())] + [("null", "s", "text", None), ("k3", None, "text", texts()[3])]
    pieces = split.split_items(chunk_frame(spark, rows)).toPandas()
    for i, t in enumerate(texts()):
        own, whole = pieces[pieces.chunk_id == f"k{i}"].sort_values("piece_no"), ""
        for start, p in zip(own.piece_start, own.content):
            whole = whole[:start] + p
        assert whole == t
    for _, own in pieces.groupby(pieces.source.fillna("")):
        assert sorted(own.chunk_index) == list(range(len(own)))
    kinds = {r.chunk_id: r.kind for r in split.oversized(chunk_frame(spark, rows)).collect()}
    assert kinds == {f"k{i}": "unbroken" if re.search(r"\S{513}", t) else "divisible" for i, t in enumerate(texts()) if len(t) > 512}


# ---- 5: ranking


def test_ranking(spark):
    rng = random.Random(2)
    rows = [(q, f"i{i}", r, float(rng.choice([1, 2, 3, 5, 8]) * s), None) for q in (1, 2) for i in range(12) for r, s in (("dense", 1), ("sparse", 1000)) if rng.random() < 0.8]
    rows += rows[:3] + [(1, "i0", "rerank", float("nan"), 0.5), (3, "only", "dense", 1.0, None), (1, None, "dense", 1.0, None)]
    frame = spark.createDataFrame(rows, "question_id long, id string, retriever string, score double, hybrid_score double")
    got = {(r.question_id, r.id): r.combined for r in ranking.combined_ranking(frame, "question_id", "id", ranking.retrieval_lists()).collect()}
    best = {}
    for q, i, r, s, h in rows:
        if i is not None:
            for name, v in ((r, s), ("hybrid", h)):
                if v is not None and v == v:
                    best[q, name, i] = max(v, best.get((q, name, i), v))
    want = {}
    for (q, name, i), v in best.items():
        own = [x for (a, b, _), x in best.items() if (a, b) == (q, name)]
        rank = sum(x < v for x in own) + (sum(x == v for x in own) + 1) / 2
        want[q, i] = want.get((q, i), 0) + NormalDist().inv_cdf((rank - 0.5) / len(own)) / 4
    assert got == pytest.approx(want, abs=1e-8)


# ---- 6: near-duplicates


def variants():
    rng = random.Random(11)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for g in range(60):
        base = [rng.choice(words) for _ in range(rng.randint(22, 260))]
        for v in range(rng.randint(1, 4)):
            own = list(base)
            for _ in range(rng.randint(0, max(1, len(own) // 12)) if v else 0):
                own[rng.randrange(len(own))] = rng.choice(words)
            rows.append((f"{g}-{v}", "s", "text", " ".join(own)))
    return rows + [("null", "s", "text", None), ("short", "s", "text", "uno due"), ("copy", "s", "text", rows[0][3].upper() + "!"), rows[1]]


def test_neardup(spark):
    rows = variants()
    got = {(r.chunk_id_a, r.chunk_id_b) for r in neardup.similar_pairs(chunk_frame(spark, rows)).collect()}
    sets = {}
    for k, _, _, t in rows:
        w = re.findall(r"[^\W_]+", (t or "").lower())
        if len(w) >= 20:
            sets[k] = set(zip(w, w[1:], w[2:]))
    want = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.6 * len(sets[a] | sets[b]) - 1e-9}
    assert len(want) > 30 and got == want
    groups = {r.chunk_id: r for r in neardup.similar_groups(chunk_frame(spark, rows)).collect()}
    first = {k: r.representative for k, r in groups.items()}
    assert set(groups) == {k for p in want for k in p} and first["copy"] == first["0-0"] == "0-0" and groups["copy"].n_copies == 2
    links = {(r.chunk_id_a, r.chunk_id_b) for r in neardup.similar_links(chunk_frame(spark, rows)).collect()}
    assert links == {tuple(sorted((first[a], first[b]))) for a, b in want if first[a] != first[b]}
    ends = [k for p in links for k in p]
    assert all(r.n_links == ends.count(r.representative) for r in groups.values())


def true_pairs(rows):
    sets = {k: set(zip(t.split(), t.split()[1:], t.split()[2:])) for k, _, _, t in rows}
    return {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.6 * len(sets[a] | sets[b]) - 1e-9}


def test_neardup_of_large_groups(spark):
    rng = random.Random(12)
    rows = []
    for g, (n, changes) in enumerate([(100, 2), (60, 3)]):
        base = [f"w{rng.randrange(5000)}" for _ in range(75)]
        for v in range(n):
            own = list(base)
            for i in rng.sample(range(75), changes):
                own[i] = f"w{rng.randrange(5000)}"
            rows.append((f"{g}-{v:03}", "s", "text", " ".join(own)))
    rows += [(f"copy{i:02}", "s", "text", rows[0][3]) for i in range(30)]
    got = {(r.chunk_id_a, r.chunk_id_b) for r in neardup.similar_pairs(chunk_frame(spark, rows)).collect()}
    want = true_pairs(rows)
    assert len(want) > 5000 and got == want, (len(got), len(want))


def test_neardup_near_the_threshold(spark):
    """Pairs of 20 to 70 words at similarities of 0.60 to 0.65."""
    rng = random.Random(13)
    rows, fresh = [], iter(range(10**6))
    for g in range(3000):
        base = [f"u{next(fresh)}" for _ in range(rng.randint(20, 70))]
        own, at = list(base), rng.sample(range(len(base)), len(base))
        size = len(base) - 2
        for i in at:
            both = len(set(zip(base, base[1:], base[2:])) & set(zip(own, own[1:], own[2:])))
            left = both - sum(own[j] == base[j] and own[j + 1] == base[j + 1] and own[j + 2] == base[j + 2] for j in range(max(0, i - 2), min(size, i + 1)))
            if left < 0.6 * (2 * size - left) - 1e-9:
                continue
            own[i] = f"u{next(fresh)}"
        both = len(set(zip(base, base[1:], base[2:])) & set(zip(own, own[1:], own[2:])))
        if 0.6 - 1e-9 <= both / (2 * size - both) <= 0.65:
            rows += [(f"{g}a", "s", "text", " ".join(base)), (f"{g}b", "s", "text", " ".join(own))]
    got = {(r.chunk_id_a, r.chunk_id_b) for r in neardup.similar_pairs(chunk_frame(spark, rows)).collect()}
    want = {(a[0], b[0]) for a, b in zip(rows[::2], rows[1::2])}
    assert len(want) > 2000 and got == want, (len(got), len(want))


@pytest.mark.parametrize("parts, split", [(1, 4096), (30, 8), (64, 64), (400, 4096)])
def test_neardup_however_rows_are_cut(spark, parts, split):
    """Pairs depend neither on the cut of the tasks nor on that of the buckets; records of common triples only are found whole."""
    rng = random.Random(6)
    stock = [" ".join(f"w{rng.randrange(50)}" for _ in range(8)) for _ in range(14)]
    rows = [(f"r{i:03}", "s", "text", " ".join(stock[j] for j in sorted(rng.sample(range(14), 7)))) for i in range(300)]
    got = {(r.chunk_id_a, r.chunk_id_b) for r in neardup.similar_pairs(chunk_frame(spark, rows).repartition(parts), split=split, cells=1 << 16).collect()}
    assert got == true_pairs(rows), len(got)  # 635


def test_neardup_of_nothing(spark):
    assert neardup.similar_pairs(chunk_frame(spark, [])).count() == 0


# ---- 7: encoding


def odd_texts():
    return [None, "", " ", "l'area d'indagine's  \n\n\tdon't <|endoftext|> €²½ 東京 😀é", "\x00\x1c a b", "x" * 5000, "parola " * 3000, "\r\n 1234567 US44-b"]


def test_encoding(spark):
    frame = spark.createDataFrame([(i * 3, t, "x") for i, t in enumerate(odd_texts())] + [(99, "parola", "y")], "doc_id long, text string, ids string")
    encode = tokens._encoder(tokens.vocabulary()).encode_ordinary
    want = {i * 3: encode(t) if t else [] for i, t in enumerate(odd_texts())} | {99: encode("parola")}
    got = tokens.encode_corpus(frame, batch_chars=2000)
    assert {r.doc_id: r.ids for r in got.collect()} == want
    assert {r.doc_id: r.text for r in tokens.decode_corpus(got).collect()} == {i * 3: t or "" for i, t in enumerate(odd_texts())} | {99: "parola"}
    assert {r.doc_id: r.n_tokens for r in tokens.encode_corpus(frame, count_only=True).collect()} == {k: len(v) for k, v in want.items()}
    assert tokens.encode_corpus(frame.limit(0)).count() == 0


# ---- 8: mixing


def test_mixing(spark):
    rng = random.Random(4)
    sizes = [(i, ("big", "mid", "small", "zero", None)[i % 5], rng.randint(5, 60)) for i in range(3000)] + [(9000, "small", 0)]
    sizes = [s for s in sizes if s[1] != "small" or s[0] % 20 == 2]
    targets = [("big", 5.0, 3), ("mid", 3.0, None), ("small", 2.0, 4), ("zero", 0.0, 9), ("missing", 4.0, 1)]
    a = spark.createDataFrame(sizes, "doc_id long, source string, n_tokens long")
    b = spark.createDataFrame(targets, "source string, target_weight double, max_repeats int")
    mixed = mixing.mix(a, b, block=16)
    rows, cap = mixing.documents(mixed).collect(), {s: m for s, _, m in targets}
    assert {r.source for r in rows} == {"big", "mid", "small"} and all(r.repeats <= (cap[r.source] or 99) for r in rows) and len({r.doc_id for r in rows}) == len(rows)
    share = {r.source: r for r in mixing.shares(mixed, mixing.plan(a, b)).collect()}
    assert all(abs(share[s].actual_share - w) < 0.002 and share[s].short_tokens < 60 for s, w in (("big", 0.5), ("mid", 0.3), ("small", 0.2), ("zero", 0), ("missing", 0)))
    assert max(r.repeats for r in rows if r.source == "small") == 4
    assert mixing.mix(a.limit(0), b).count() == 0
    # at every prefix each source has its share but for a few blocks or documents
    uses = sorted((r.slot, r.round, r.doc_id, r.source, r.n_tokens) for r in mixed.collect())
    assert len(uses) == sum(r.repeats for r in rows) and len({(d, n) for _, n, d, _, _ in uses}) == len(uses)
    sums, total, worst = {"big": 0, "mid": 0, "small": 0}, 0, 0.0
    for _, _, _, source, n in uses:
        sums[source] += n
        total += n
        worst = max(worst, *(abs(sums[s] - w * total) for s, w in (("big", 0.5), ("mid", 0.3), ("small", 0.2))))
    assert worst <= 4 * 60, worst


def test_mixing_beyond_the_scarcest_source(spark):
    a = spark.createDataFrame([(i, "rare" if i < 10 else "rich", 10) for i in range(1000)], "doc_id long, source string, n_tokens long")
    b = spark.createDataFrame([("rare", 0.5, 2), ("rich", 0.5, None)], "source string, target_weight double, max_repeats int")
    mixed = mixing.mix(a, b, total_tokens=4000, block=16)
    share = {r.source: r for r in mixing.shares(mixed, mixing.plan(a, b, 4000)).collect()}
    assert (share["rare"].used_tokens, share["rare"].short_tokens, share["rare"].most_repeats) == (200, 1800.0, 2)
    assert (share["rich"].used_tokens, share["rich"].short_tokens) == (2000, 0.0)


# ---- 9: shared spans


@pytest.mark.parametrize("hot, filter_bits", [(5_000, 1 << 27), (1, 1 << 27), (2, 0), (5_000, 0)])
def test_spans(spark, hot, filter_bits):
    """The same spans with and without a filter, and however many contexts make a signature hot."""
    rng = random.Random(8)
    make = lambda n: "".join(rng.choice("abcdefghij é\n") for _ in range(n))
    common, notice = make(700), make(230)
    docs = [make(300) + common[:500] + make(100) + notice, make(50) + common[200:] + make(250), notice + make(400), make(900), "", None, make(199)]
    docs += [common, common, make(120) + notice * 2, make(60) + make(250) * 2, common[:199], notice + common[300:520]]
    frame = spark.createDataFrame([(i, t, "x") for i, t in enumerate(docs)], "doc_id long, text string, start string")
    got = {(r.doc_id, r.span_start, r.span_end) for r in spans.shared_spans(frame, hot=hot, filter_bits=filter_bits).collect()}
    where = {}
    for i, t in enumerate(docs):
        for s in range(len(t or "") - 199):
            where.setdefault(t[s : s + 200], set()).add(i)
    want = set()
    for i, t in enumerate(docs):
        hit = [s for s in range(len(t or "") - 199) if len(where[t[s : s + 200]]) > 1]
        runs = []
        for s in hit:
            if runs and s <= runs[-1][1]:
                runs[-1][1] = s + 200
            else:
                runs.append([s, s + 200])
        want |= {(i, a, b) for a, b in runs}
    assert len(want) > 6 and got == want
    share = {r.doc_id: r for r in spans.shared_share(frame, hot=hot, filter_bits=filter_bits).collect()}
    assert share[7].share == 1 and share[7].cluster == share[0].cluster == share[2].cluster and set(share) == {i for i, _, _ in want}


def test_spans_of_one_notice_in_many(spark):
    rng = random.Random(9)
    make = lambda n: "".join(rng.choice("abcdefghij é") for _ in range(n))
    notice = make(230)
    docs = [(i, make(60 + i % 50) + notice + make(40)) for i in range(12_000)]
    found = spans.shared_spans(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    starts = {i: 60 + i % 50 for i, _ in docs}
    # a letter beside the notice may be the same in two texts
    assert len(found) == len(docs) and all(r.span_start <= starts[r.doc_id] and r.span_end >= starts[r.doc_id] + 230 for r in found)
    assert sum(r.span_start == starts[r.doc_id] for r in found) < len(docs)
