"""STR, TXT and JSN: strings, messages and JSON."""
from pyspark.sql import functions as F

from hectara.catalog.ranking import CAND, LABEL, candidates
from hectara.catalog.registry import query
from hectara.functions import constants as C
from hectara.functions import texts as T
from hectara.operators import ranking as W
from hectara.operators import search as S
from hectara.operators import messages as M


@query("str_01_pipe_lists", "SELECT zone_id, nullif(array_to_string(list_filter([profil_podstawowy, profil_dodatkowy], lambda x: x IS NOT NULL), '|'), '') AS joined, len(string_split(profil_podstawowy, '|')) AS n FROM zones")
def pipe_lists(t):
    both = F.array_compact(F.array("profil_podstawowy", "profil_dodatkowy"))
    return t("zones").select("zone_id", T.joined(both).alias("joined"), F.when(F.col("profil_podstawowy").isNotNull(), F.size(F.split("profil_podstawowy", "[|]"))).alias("n"))


@query(
    "str_02_profile_code",
    "WITH h AS (SELECT zone_id, CASE WHEN zone_id % 3 = 0 THEN 'http://x/none' ELSE concat('http://x/KPT-MPZP-', symbol, '/v1') END AS href FROM zones) SELECT zone_id, nullif(regexp_extract(href, 'KPT-MPZP-(\\w+)', 1), '') AS code FROM h",
)
def profile_code(t):
    href = F.when(F.col("zone_id") % 3 == 0, "http://x/none").otherwise(F.concat(F.lit("http://x/KPT-MPZP-"), "symbol", F.lit("/v1")))
    return t("zones").select("zone_id", T.profile_code(href).alias("code"))


@query("str_03_slug", "SELECT doc_id, replace(replace(lower(text), ' ', '_'), '-', '_') AS slug FROM documents")
def slug(t):
    return t.raw("documents").select("doc_id", T.slug(F.col("text")).alias("slug"))


@query("str_04_fold", "SELECT conv_id, turn, translate(lower(text), 'ńó', 'no') AS folded FROM messages")
def fold(t):
    return t("messages").select("conv_id", "turn", T.fold_city(F.col("text")).alias("folded"))


PLACES = ["Okolice ", "dzielnica ", "w ", "blisko centrum ", "", "M. "]
ENDS = ["", "a", "i", "u", "ej"]


def _chain_sql():
    """One subquery per prefix, so the text does not double at every step."""
    src = "SELECT id_dzialki, trim(lower(raw)) AS c FROM r"
    for p in C.LOCATION_PREFIXES:
        src = f"SELECT id_dzialki, trim(CASE WHEN starts_with(c, '{p}') THEN substr(c, {len(p) + 1}) ELSE c END) AS c FROM ({src})"
    return src


RAWLOC = "concat(CASE pk % 6 " + " ".join(f"WHEN {i} THEN '{p}'" for i, p in enumerate(PLACES)) + " END, gmina, CASE pk % 5 " + " ".join(f"WHEN {i} THEN '{p}'" for i, p in enumerate(ENDS)) + " END)"


def raw_locations(t):
    k = F.col("pk")
    pre = F.element_at(F.array(*[F.lit(p) for p in PLACES]), (k % 6 + 1).cast("int"))
    end = F.element_at(F.array(*[F.lit(p) for p in ENDS]), (k % 5 + 1).cast("int"))
    return t("parcels").select("id_dzialki", F.concat(pre, "gmina", end).alias("raw"))


@query(
    "str_05_location_cleanup",
    f"""WITH r AS (SELECT id_dzialki, {RAWLOC} AS raw FROM parcels), c AS ({_chain_sql()})
        SELECT id_dzialki, c AS cleaned, array_to_string(list_filter([c, CASE WHEN ends_with(c,'a') THEN c[:-2] END, CASE WHEN ends_with(c,'i') THEN c[:-2] || 'a' END, CASE WHEN ends_with(c,'u') THEN c[:-2] END, CASE WHEN ends_with(c,'ej') THEN c[:-3] || 'a' END], lambda x: x IS NOT NULL), '|') AS variants FROM c""",
)
def location_cleanup(t):
    c = raw_locations(t).select("id_dzialki", T.clean_location(F.col("raw")).alias("cleaned"))
    return c.select("id_dzialki", "cleaned", F.array_join(T.declension_variants(F.col("cleaned")), "|").alias("variants"))


_SIZE = "CASE size_category WHEN 'mala' THEN 'mała' WHEN 'pod_dom' THEN 'idealna pod dom' WHEN 'duza' THEN 'duża' WHEN 'bardzo_duza' THEN 'bardzo duża' ELSE '' END"
_WATER = "CASE nearest_water_type WHEN 'morze' THEN 'morza' WHEN 'jezioro' THEN 'jeziora' WHEN 'rzeka' THEN 'rzeki' WHEN 'kanal' THEN 'kanału' WHEN 'staw' THEN 'stawu' ELSE 'wody' END"


@query(
    "str_06_description",
    f"""SELECT id_dzialki, concat_ws(' ', concat('Działka w ', coalesce(dzielnica, 'nieznana dzielnica'), ', ', gmina, '.'), CASE WHEN area_m2 > 0 THEN format('Powierzchnia {{}} m² ({{}}).', area_m2, {_SIZE}) END,
        CASE typ_wlasnosci WHEN 'prywatna' THEN 'Własność prywatna - można kupić.' WHEN 'publiczna' THEN 'Własność publiczna.' END,
        CASE WHEN is_built THEN concat('Zabudowana - ', coalesce(building_type, 'budynek'), '.') ELSE 'Niezabudowana - wolna pod budowę.' END,
        CASE WHEN quietness_score IS NULL THEN NULL WHEN kategoria_ciszy='bardzo_cicha' THEN format('Bardzo cicha okolica (cisza {{}}/100).', quietness_score) WHEN kategoria_ciszy='cicha' THEN format('Cicha okolica (cisza {{}}/100).', quietness_score) WHEN kategoria_ciszy='umiarkowana' THEN 'Umiarkowany poziom hałasu.' ELSE 'Głośna okolica - blisko drogi głównej.' END,
        CASE WHEN nature_score IS NULL THEN NULL WHEN kategoria_natury='bardzo_zielona' THEN format('Bardzo zielona okolica, blisko natury (natura {{}}/100).', nature_score) WHEN kategoria_natury='zielona' THEN 'Zielona okolica z dostępem do natury.' WHEN kategoria_natury='umiarkowana' THEN 'Umiarkowanie zielona okolica.' ELSE 'Zurbanizowana okolica.' END,
        CASE WHEN accessibility_score IS NULL THEN NULL WHEN accessibility_score>=70 THEN 'Doskonała dostępność komunikacyjna i usług.' WHEN accessibility_score>=50 THEN 'Dobra dostępność usług.' WHEN accessibility_score>=30 THEN 'Umiarkowana dostępność.' ELSE 'Ograniczona dostępność - spokojne przedmieścia.' END,
        CASE WHEN nearest_water_type IS NOT NULL AND dist_to_water > 0 THEN CASE WHEN dist_to_water<500 THEN format('Blisko {{}} ({{}}m).', {_WATER}, dist_to_water) WHEN dist_to_water<1000 THEN format('W pobliżu {{}} ({{}}m).', {_WATER}, dist_to_water) END END,
        CASE WHEN dist_to_forest<200 THEN format('Bezpośrednio przy lesie ({{}}m).', dist_to_forest) WHEN dist_to_forest<500 THEN format('Blisko lasu ({{}}m).', dist_to_forest) END,
        CASE WHEN dist_to_school<500 THEN format('Szkoła w zasięgu spaceru ({{}}m).', dist_to_school) WHEN dist_to_school<1000 THEN format('Szkoła w pobliżu ({{}}m).', dist_to_school) END,
        CASE WHEN dist_to_bus_stop<300 THEN format('Przystanek autobusowy bardzo blisko ({{}}m).', dist_to_bus_stop) WHEN dist_to_bus_stop<500 THEN format('Dobry dostęp do komunikacji ({{}}m do przystanku).', dist_to_bus_stop) END,
        CASE WHEN pog_symbol IS NULL THEN NULL WHEN is_residential_zone THEN concat('Strefa ', pog_symbol, ' - przeznaczona pod zabudowę mieszkaniową.') ELSE concat('Strefa planistyczna ', pog_symbol, '.') END,
        CASE gestosc_zabudowy WHEN 'bardzo_rzadka' THEN 'Bardzo rzadka zabudowa w okolicy - dużo przestrzeni.' WHEN 'rzadka' THEN 'Rzadka zabudowa - spokojna okolica.' WHEN 'umiarkowana' THEN 'Umiarkowana gęstość zabudowy.' WHEN 'gesta' THEN 'Gęsta zabudowa w okolicy.' END) AS description FROM parcels""",
)
def description(t):
    return t("parcels").select("id_dzialki", T.description().alias("description"))


THOUSANDS = "replace(format('{:,}', area_m2), ',', ' ')"
MATCHED = """coalesce(nullif(concat_ws(', ', CASE WHEN coalesce(quietness_score,0) >= 85 THEN format('bardzo cicha okolica ({}/100)', quietness_score) WHEN coalesce(quietness_score,0) >= 70 THEN format('cicha okolica ({}/100)', quietness_score) END), ''), 'dopasowanie do kryteriów')"""
PWORD = "CASE profile WHEN 'quiet' THEN 'cichsza' WHEN 'green' THEN 'bardziej zielona' WHEN 'accessible' THEN 'lepszy dojazd' ELSE 'większa' END"
DIFFERS = f"""coalesce(nullif(concat_ws(', ', CASE WHEN dzielnica IS DISTINCT FROM bd THEN concat('inna dzielnica: ', coalesce(dzielnica, 'None')) END, CASE WHEN profile <> bp THEN {PWORD} END,
  CASE WHEN coalesce(area_m2,0)-coalesce(ba,0) >= 200 THEN format('+{{}}m² większa', coalesce(area_m2,0)-coalesce(ba,0)) WHEN coalesce(area_m2,0)-coalesce(ba,0) <= -200 THEN format('{{}}m² mniejsza', coalesce(area_m2,0)-coalesce(ba,0)) END), ''), 'alternatywna opcja')"""


@query(
    "str_07_explanations",
    f"""WITH {CAND}, o AS (SELECT *, {LABEL} AS label, CASE step WHEN 2 THEN {DIFFERS} WHEN 3 THEN surprise ELSE {MATCHED} END AS reason FROM pos WHERE position <= 3)
        SELECT gmina AS search_id, position, reason, concat_ws(chr(10), concat('**', position, '. ', coalesce(dzielnica, miejscowosc), '** (', label, ')'),
          nullif(concat_ws(' | ', CASE WHEN area_m2 > 0 THEN concat('📐 ', {THOUSANDS}, ' m²') END, CASE WHEN dist_to_forest > 0 THEN format('🌲 Las: {{}}m', dist_to_forest) END, CASE WHEN quietness_score > 0 THEN format('🔇 Cisza: {{}}/100', quietness_score) END,
          CASE WHEN dist_to_school > 0 AND dist_to_school < 1000 THEN format('🏫 Szkoła: {{}}m', dist_to_school) END), ''), concat('→ ', reason)) AS display FROM o""",
)
def explanations(t):
    p = W.diverse_proposals(candidates(t), ["quiet", "cicha"])
    return p.select("search_id", "position", "reason", T.display_line(F.col("position"), F.col("label"), F.col("reason")).alias("display"))


@query(
    "str_08_highlights",
    f"""SELECT id_dzialki, array_to_string(list_filter([CASE WHEN quietness_score >= 75 THEN format('Cisza: {{}}/100', quietness_score) END, CASE WHEN nature_score >= 70 THEN format('Natura: {{}}/100', nature_score) END,
        CASE WHEN dist_to_forest < 300 OR (dist_to_forest > 0 AND dist_to_forest <= 800) THEN format('Las: {{}}m', dist_to_forest) END, CASE WHEN dist_to_water > 0 AND dist_to_water <= 400 THEN format('Woda: {{}}m', dist_to_water) END,
        CASE WHEN accessibility_score >= 80 THEN format('Dostępność: {{}}/100', accessibility_score) END, CASE WHEN dist_to_main_road < 50 THEN 'Dostęp do drogi' END, CASE WHEN has_pog THEN coalesce('MPZP: ' || pog_symbol, 'Ma MPZP') END], lambda x: x IS NOT NULL)[1:2], '|') AS highlights,
        concat_ws(', ', miejscowosc, CASE WHEN area_m2 > 0 THEN concat({THOUSANDS}, ' m²') END) AS label FROM parcels""",
)
def highlights(t):
    return t("parcels").select("id_dzialki", F.array_join(T.highlights({"quiet", "road"}, forest_m=800, water_m=400), "|").alias("highlights"), T.short_label().alias("label"))


@query(
    "str_09_card_summary",
    """SELECT id_dzialki, concat_ws('|', concat('Lokalizacja: ', miejscowosc, ', ', gmina), CASE WHEN area_m2 > 0 THEN format('Powierzchnia: {:,} m²', area_m2) END, CASE WHEN NOT is_built THEN 'Niezabudowana' WHEN building_count > 0 THEN format('Zabudowana ({} bud.)', building_count) ELSE 'Zabudowana' END,
       CASE WHEN quietness_score IS NOT NULL THEN format('Cisza: {}/100 ({})', quietness_score, kategoria_ciszy) END, CASE WHEN nature_score IS NOT NULL THEN format('Natura: {}/100 ({})', nature_score, kategoria_natury) END,
       CASE WHEN accessibility_score IS NOT NULL THEN format('Dostępność: {}/100 ({})', accessibility_score, kategoria_dostepu) END,
       CASE WHEN nearest_water_type IS NOT NULL AND (CASE nearest_water_type WHEN 'morze' THEN dist_to_sea ELSE dist_to_water END) > 0 THEN format('Woda: {} ({}m)', CASE nearest_water_type WHEN 'morze' THEN 'Morze' WHEN 'zatoka' THEN 'Zatoka' WHEN 'rzeka' THEN 'Rzeka' WHEN 'jezioro' THEN 'Jezioro' WHEN 'kanal' THEN 'Kanał' ELSE 'Staw' END, CASE nearest_water_type WHEN 'morze' THEN dist_to_sea ELSE dist_to_water END) END) AS summary FROM parcels""",
)
def card_summary(t):
    return t("parcels").select("id_dzialki", F.array_join(T.card_summary(), "|").alias("summary"))


BUDGET_SQL = "TRY_CAST(coalesce(" + ", ".join(f"nullif(regexp_extract(c, '{p}', 1), '')" for p in C.BUDGET_PATTERNS) + ") AS BIGINT)"
SIZE_SQL = "coalesce(" + ", ".join(f"CASE WHEN TRY_CAST(nullif(regexp_extract(c, '{p}', 1), '') AS BIGINT) BETWEEN 100 AND 10000 THEN TRY_CAST(regexp_extract(c, '{p}', 1) AS BIGINT) END" for p in C.SIZE_PATTERNS) + ")"


@query(
    "txt_01_numbers",
    f"""WITH m AS (SELECT conv_id, turn, lower(text) AS c FROM messages WHERE role='user'), n AS (SELECT conv_id, turn, {BUDGET_SQL} AS b, {SIZE_SQL} AS s FROM m)
        SELECT conv_id, turn, CASE WHEN b < 10000 THEN b*1000 ELSE b END AS budget, s AS size_m2, CAST(floor(s*0.8e0) AS INT) AS size_min, CAST(floor(s*1.2e0) AS INT) AS size_max FROM n""",
)
def numbers(t):
    return M.numeric_wishes(t("messages"))


@query(
    "txt_02_keywords",
    "WITH m AS (SELECT conv_id, lower(text) AS c FROM messages WHERE role='user'), w AS ("
    + " UNION ALL ".join(f"SELECT conv_id, '{d}' AS dim, {v}e0 AS v FROM m WHERE contains(c, '{w}')" for w, d, v in C.PREFERENCE_WORDS)
    + "), h AS (" + " UNION ALL ".join(f"SELECT conv_id, '{h}' AS hint FROM m WHERE contains(c, '{w}')" for w, h in C.HINT_WORDS)
    + ") SELECT conv_id, 'weight' AS kind, dim AS name, max(v) AS value FROM w GROUP BY 1, 3 UNION ALL SELECT DISTINCT conv_id, 'hint', hint, NULL FROM h",
)
def keywords(t):
    return M.keyword_wishes(t("messages"))


@query(
    "txt_03_rule_facts",
    "WITH m AS (SELECT conv_id, lower(text) AS c FROM messages WHERE role='user') SELECT DISTINCT * FROM ("
    + " UNION ALL ".join(f"SELECT conv_id, '{k}' AS kind, '{v}' AS value FROM m WHERE " + " OR ".join(f"contains(c, '{w}')" for w in words) for k, v, words in C.FACT_RULES) + ")",
)
def rule_facts(t):
    return M.session_facts(t("messages"))


def _any(words):
    return "(" + " OR ".join(f"contains(c, '{w}')" for w in words) + ")"


def _list(rules):
    return "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {_any(w)} THEN '{n}' END" for n, w in rules) + "], lambda x: x IS NOT NULL), '|')"


@query(
    "txt_04_feedback",
    f"""WITH m AS (SELECT conv_id, turn, lower(text) AS c FROM messages WHERE role='user'),
        l AS (SELECT conv_id, turn, c, list_filter([{", ".join(f"CASE WHEN contains(c, '{w}') THEN '{f}' END" for w, f in C.LIKED_WORDS)}], lambda x: x IS NOT NULL) AS l FROM m)
        SELECT conv_id, turn, CASE {" ".join(f"WHEN {_any(w)} THEN {i}" for i, w in C.CHOICE_WORDS)} END AS choice, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), '|') AS liked, {_list(C.REQUIREMENT_WORDS)} AS wanted, {_list(C.DISLIKED_WORDS)} AS disliked FROM l""",
)
def feedback(t):
    return M.parsed_feedback(t("messages"))


@query("txt_05_intent", f"WITH m AS (SELECT conv_id, turn, lower(text) AS c FROM messages WHERE role='user') SELECT conv_id, turn, CASE {' '.join(f'WHEN {_any(w)} THEN {chr(39)}{n}{chr(39)}' for n, w in C.INTENT_RULES)} ELSE 'general' END AS intent FROM m")
def intent(t):
    return M.user_turns(t("messages")).select("conv_id", "turn", T.intent(F.col("c")).alias("intent"))


WORDING = ["większa działka", "coś mniejszego, spokojnie", "bliżej lasu, zieleń", "lepszy dojazd i sklep", "dalej od fabryk, mniej hałasu", "z planem MPZP", "duża i cicha", "mała"]
SAID = "(CASE search_id % 8 " + " ".join(f"WHEN {i} THEN '{w}'" for i, w in enumerate(WORDING)) + " END)"


@query(
    "txt_06_adjustments",
    f"""WITH a AS (SELECT *, lower({SAID}) AS c, coalesce(min_area, 0) AS mn, coalesce(max_area, 10000) AS mx FROM searches),
        g AS (SELECT *, CASE WHEN {_any(['większ', 'duż'])} THEN mn*1.5e0 ELSE CAST(min_area AS DOUBLE) END AS a1, CASE WHEN {_any(['większ', 'duż'])} AND mn*1.5e0 >= mx THEN mn*1.5e0*1.5e0 ELSE CAST(max_area AS DOUBLE) END AS b1 FROM a),
        s AS (SELECT *, CASE WHEN {_any(['mniejsz', 'mał'])} AND mn >= mx*0.7e0 THEN mx*0.7e0*0.5e0 ELSE a1 END AS a2, CASE WHEN {_any(['mniejsz', 'mał'])} THEN mx*0.7e0 ELSE b1 END AS b2 FROM g)
        SELECT search_id, round(CASE WHEN coalesce(a2,0) > coalesce(b2,10000) THEN b2 ELSE a2 END, 3) AS min_area, round(CASE WHEN coalesce(a2,0) > coalesce(b2,10000) THEN a2 ELSE b2 END, 3) AS max_area,
          CASE WHEN {_any(['cich', 'spok'])} THEN 'bardzo_cicha|cicha' ELSE quiet_cats END AS quiet_cats, CASE WHEN {_any(['cich', 'spok'])} THEN 'rzadka|bardzo_rzadka' ELSE density_cats END AS density_cats,
          CASE WHEN {_any(['natur', 'las', 'zielen'])} THEN 'bardzo_zielona|zielona' ELSE nature_cats END AS nature_cats, CASE WHEN {_any(['natur', 'las', 'zielen'])} AND coalesce(forest_m,0)=0 THEN 500 ELSE forest_m END AS forest_m,
          CASE WHEN {_any(['dojazd', 'sklep', 'szkol'])} THEN 'doskonala|dobra' ELSE access_cats END AS access_cats, CASE WHEN {_any(['przemysł', 'fabryk', 'hałas'])} THEN coalesce(nullif(industrial_m,0),500)+500 ELSE industrial_m END AS industrial_m,
          {_any(['mpzp', 'plan'])} AS has_pog FROM s""",
)
def adjustments(t):
    said = F.element_at(F.array(*[F.lit(w) for w in WORDING]), (F.col("search_id") % 8 + 1).cast("int"))
    return M.adjusted_criteria(t("searches"), said)


@query(
    "txt_07_style_tags",
    f"""WITH m AS (SELECT conv_id, turn, text, lower(text) AS c FROM messages WHERE role='user'), g AS (SELECT conv_id, turn, CASE WHEN length(text) < 20 THEN 'short' WHEN length(text) > 200 THEN 'long' END AS len, {", ".join(f"{_any(w)} AS {n}" for n, w in C.STYLE_WORDS.items())} FROM m)
        SELECT conv_id, arg_max(len, turn) FILTER (len IS NOT NULL) AS response_length, bool_or(jargon) AS jargon, bool_or(investment) AS investment, bool_or(nature) AS nature, bool_or(data) AS data FROM g GROUP BY conv_id""",
)
def style_tags(t):
    return M.style_tags(t("messages"))


@query("jsn_01_state_path", "SELECT order_no, json_extract_string(state, '$.working.current_phase') AS phase, CAST(json_extract_string(state, '$.n') AS INT) AS n FROM states")
def state_path(t):
    parsed = F.from_json("state", "working struct<current_phase:string>, n int")
    return t("states").select("order_no", parsed.alias("s")).select("order_no", F.col("s.working.current_phase").alias("phase"), "s.n")


@query("vec_05_query_text", """SELECT search_id, coalesce(nullif(concat_ws('. ', 'Działka w ' || coalesce(miejscowosc, gmina), CASE WHEN quiet_cats IS NOT NULL THEN 'cicha spokojna okolica' END, CASE WHEN nature_cats IS NOT NULL THEN 'blisko natury lasu zieleni' END,
   CASE WHEN build_status='niezabudowana' THEN 'niezabudowana pod budowę domu' END, CASE WHEN ownership_type='prywatna' THEN 'prywatna do kupienia' END), ''), 'działka budowlana pod dom') AS query_text FROM searches""")
def query_text(t):
    c = F.col
    return S.split_lists(t("searches")).select("search_id", T.search_text(c("miejscowosc"), c("gmina"), c("quiet_cats"), c("nature_cats"), c("build_status"), c("ownership_type")).alias("query_text"))
