"""Fixed values of the domain: word lists, lookup tables, thresholds. Results depend on them exactly."""

# ---- fixed values: ownership registers ----
OWNER_GROUP_NAMES = {
    "1": "Skarb Państwa",
    "2": "Skarb Państwa (w zarządzie)",
    "3": "Spółki Skarbu Państwa",
    "4": "Gminy (własność)",
    "5": "Gminy (w zarządzie)",
    "6": "Spółki komunalne",
    "7": "Osoby fizyczne",
    "8": "Spółdzielnie",
    "9": "Kościoły i związki wyznaniowe",
    "10": "Wspólnoty gruntowe",
    "11": "Powiaty (własność)",
    "12": "Powiaty (w zarządzie)",
    "13": "Województwa (własność)",
    "14": "Województwa (w zarządzie)",
    "15": "Inne podmioty publiczne",
    "16": "Inne",
}
# Type of each registration group.
OWNERSHIP_TYPES = {
    "1": "publiczna",
    "2": "publiczna",
    "3": "publiczna",
    "4": "publiczna",
    "5": "publiczna",
    "6": "publiczna",
    "7": "prywatna",
    "8": "spółdzielcza",
    "9": "kościelna",
    "10": "wspólnota",
    "11": "publiczna",
    "12": "publiczna",
    "13": "publiczna",
    "14": "publiczna",
    "15": "publiczna",
    "16": "inna",
}
OWNERSHIP_IDS = {
    "prywatna": "prywatna",
    "publiczna": "publiczna",
    "spółdzielcza": "spoldzielcza",
    "kościelna": "koscielna",
    "inna": "inna",
}

# ---- fixed values: zoning ----
RESIDENTIAL_SYMBOLS = ["SW", "SJ", "SN", "SU", "SM"]
INFRASTRUCTURE_SYMBOLS = ["SK", "SI"]
RESIDENTIAL_PROFILES = ["MN", "MW"]
BUILDABLE_TYPES = {
    "SJ": "jednorodzinna",
    "SW": "wielorodzinna",
    "SN": "wielorodzinna",
    "SC": "centrum",
    "SU": "uslugowa",
    "SP": "przemyslowa",
    "SG": "gospodarcza",
    "SH": "handlowa",
    "SK": "komunikacja",
    "SI": "infrastruktura",
    "SZ": "zielona",
    "SO": "ochronna",
    "SR": "rekreacyjna",
}

# ---- fixed values: score bands, highest first; the last label takes the rest ----
BANDS = {
    "quietness": ([(80, "bardzo_cicha"), (60, "cicha"), (40, "umiarkowana")], "glosna"),
    "nature": ([(70, "bardzo_zielona"), (50, "zielona"), (30, "umiarkowana")], "zurbanizowana"),
    "accessibility": ([(70, "doskonala"), (50, "dobra"), (30, "umiarkowana")], "ograniczona"),
    "density": ([(50, "gesta"), (20, "umiarkowana"), (5, "rzadka")], "bardzo_rzadka"),
}
UNKNOWN_BAND = "nieznana"
SIZE_CLASSES = {
    "pipeline": ([(500, "mala"), (1500, "pod_dom"), (5000, "duza")], "bardzo_duza"),
    "dimension": ([(500, "mala"), (2000, "pod_dom"), (5000, "duza")], "bardzo_duza"),
}

# ---- fixed values: water ----
WATER_ORDER = ["morze", "rzeka", "jezioro", "kanal", "staw"]
WATER_DISTANCE_COLUMNS = {
    "morze": "dist_to_sea",
    "zatoka": "dist_to_sea",
    "rzeka": "dist_to_river",
    "jezioro": "dist_to_lake",
    "kanal": "dist_to_canal",
    "staw": "dist_to_pond",
}
# type: (priority, premium factor, proximity threshold in metres)
WATER_TYPES = {
    "morze": (1, 2.0, 1000),
    "zatoka": (2, 1.8, 1000),
    "rzeka": (3, 1.3, 300),
    "jezioro": (4, 1.5, 500),
    "kanal": (5, 1.1, 200),
    "staw": (6, 1.05, 100),
}
# Names tried in this order; a name matches when the body's name contains it.
WATER_NAMES = [
    ("zatoka", ["zatoka gdańska", "zatoka pucka", "zatoka"]),
    (
        "rzeka",
        [
            "wisła", "martwa wisła", "przekop wisły", "radunia", "motława", "nowa motława", "stara motława",
            "opływ motławy", "strzyża", "potok oliwski", "kacza", "chylonka", "swelina", "kamienna", "rozwójka",
            "potok siedlecki", "łaba", "oruński potok", "karaś", "bielawa", "jasień",
        ],
    ),
    (
        "kanal",
        [
            "kanał raduni", "kanał raduński", "czarna łacha", "kanał czarna łacha", "kanał wielki", "kanał piaskowy",
            "kanał młynówka", "kanał na stępce", "kanał kaszubski", "kanał",
        ],
    ),
    (
        "jezioro",
        [
            "jezioro osowskie", "osowskie", "jezioro jasień", "jasień", "jezioro wysockie", "wysockie", "jezioro czarne",
            "czarne", "jezioro otomińskie", "otomińskie", "jezioro jelitkowskie", "zbiornik powstańców warszawskich",
            "jezioro", "zbiornik",
        ],
    ),
    ("staw", ["staw", "sadzawka", "oczko"]),
]
LAKE_MIN_AREA = 10000

# ---- fixed values: buildings ----
BUILDING_FUNCTIONS = {
    "budynki mieszkalne": "mieszkalne",
    "budynki produkcyjne, usługowe i gospodarcze dla rolnictwa": "gospodarcze",
    "budynki handlowo-usługowe": "handlowo-usługowe",
    "budynki przemysłowe": "przemysłowe",
    "budynki transportu i łączności": "transport",
    "budynki biurowe": "biurowe",
    "zbiorniki, silosy i budynki magazynowe": "magazynowe",
    "pozostałe budynki niemieszkalne": "inne",
    "budynki oświaty, nauki i kultury oraz budynki sportowe": "edukacja/kultura",
    "budynki szpitali i inne budynki opieki zdrowotnej": "zdrowie",
}

# ---- fixed values: neighbourhood relations: type -> (relation, threshold m, nearest kept) ----
NEAR_RELATIONS = {
    "school": ("NEAR_SCHOOL", 2000, 3),
    "bus_stop": ("NEAR_BUS_STOP", 1000, 5),
    "shop": ("NEAR_SHOP", 1500, 5),
    "water": ("NEAR_WATER", 500, 3),
    "forest": ("NEAR_FOREST", 500, 3),
    "main_road": ("NEAR_ROAD", 200, 2),
}
SINGLE_NEAR_THRESHOLDS = {
    "NEAR_SCHOOL": ("dist_to_school", 1000),
    "NEAR_BUS_STOP": ("dist_to_bus_stop", 500),
    "NEAR_FOREST": ("dist_to_forest", 500),
    "NEAR_SUPERMARKET": ("dist_to_supermarket", 1000),
    "NEAR_MAIN_ROAD": ("dist_to_main_road", 200),
}

# ---- fixed values: text rules ----
BUDGET_PATTERNS = [r"(\d+)\s*(?:tys|k|tyś)", r"(\d+)\s*(?:000|złotych|zł)", r"budżet[^\d]*(\d+)", r"do\s*(\d+)\s*(?:tys|k)"]
SIZE_PATTERNS = [r"(\d+)\s*m[²2]", r"(\d+)\s*metr", r"(\d{3,4})"]
PREFERENCE_WORDS = [
    ("cicho", "quietness", 0.8),
    ("cisza", "quietness", 0.8),
    ("spokój", "quietness", 0.7),
    ("spokojna", "quietness", 0.7),
    ("spokojne", "quietness", 0.7),
    ("spokojny", "quietness", 0.7),
    ("las", "nature", 0.8),
    ("lasu", "nature", 0.8),
    ("lasem", "nature", 0.8),
    ("natura", "nature", 0.8),
    ("natury", "nature", 0.8),
    ("zieleń", "nature", 0.7),
    ("zielona", "nature", 0.7),
    ("zielone", "nature", 0.7),
    ("zieleni", "nature", 0.7),
    ("szkoła", "schools", 1.0),
    ("szkoły", "schools", 1.0),
    ("szkole", "schools", 1.0),
    ("sklep", "accessibility", 0.6),
    ("sklepu", "accessibility", 0.6),
    ("komunikacja", "accessibility", 0.7),
    ("komunikacji", "accessibility", 0.7),
    ("autobus", "accessibility", 0.6),
    ("tramwaj", "accessibility", 0.6),
]
HINT_WORDS = [
    ("rodzina", "Wspomniałeś o rodzinie - czy bliskość szkół jest dla Ciebie ważna?"),
    ("rodziny", "Wspomniałeś o rodzinie - czy bliskość szkół jest dla Ciebie ważna?"),
    ("rodzinę", "Wspomniałeś o rodzinie - czy bliskość szkół jest dla Ciebie ważna?"),
    ("dzieci", "Masz dzieci - czy szkoły i przedszkola są ważne?"),
    ("dziecko", "Masz dziecko - czy szkoły i przedszkola są ważne?"),
    ("wsi", "Wspomniałeś o wsi - szukasz rzadkiej zabudowy na obrzeżach?"),
    ("wieś", "Wspomniałeś o wsi - szukasz rzadkiej zabudowy na obrzeżach?"),
    ("wiejska", "Wspomniałeś o charakterze wiejskim - szukasz rzadkiej zabudowy?"),
    ("wiejski", "Wspomniałeś o charakterze wiejskim - szukasz rzadkiej zabudowy?"),
    ("podmiejska", "Wspomniałeś o charakterze podmiejskim - umiarkowana zabudowa?"),
    ("podmiejski", "Wspomniałeś o charakterze podmiejskim - umiarkowana zabudowa?"),
    ("inwestycja", "Szukasz działki inwestycyjnej - czy ma być budowlana (MN/U)?"),
    ("inwestycji", "Szukasz działki inwestycyjnej - czy ma być budowlana (MN/U)?"),
    ("inwestycyjne", "Szukasz działki inwestycyjnej - czy ma być budowlana (MN/U)?"),
    ("inwestycyjną", "Szukasz działki inwestycyjnej - czy ma być budowlana (MN/U)?"),
]
FACT_RULES = [
    ("fact", "ma dzieci", ["dzieci", "dziecko", "syn", "córka", "szkoła", "przedszkole"]),
    ("profile", "priority_schools", ["dzieci", "dziecko", "syn", "córka", "szkoła", "przedszkole"]),
    ("fact", "pracuje w Gdańsk", ["pracuję w gdańsk", "pracuje w gdańsk"]),
    ("fact", "pracuje w Gdynia", ["pracuję w gdynia", "pracuje w gdynia"]),
    ("fact", "pracuje w Sopot", ["pracuję w sopot", "pracuje w sopot"]),
    ("intent", "urgent_timeline", ["pilne", "szybko", "jak najszybciej", "w tym miesiącu"]),
    ("profile", "urgency", ["pilne", "szybko", "jak najszybciej", "w tym miesiącu"]),
    ("intent", "financing_inquiry", ["kredyt", "hipoteka", "finansowanie"]),
    ("intent", "comparing_options", ["porównaj", "która lepsza", "vs", "versus"]),
    ("profile", "priority_nature", ["las", "natura", "zieleń", "spokój", "cisza"]),
    ("profile", "priority_quietness", ["las", "natura", "zieleń", "spokój", "cisza"]),
]
INTENT_RULES = [
    ("search", ["szukaj", "znajdź", "wyszukaj", "pokaż działki"]),
    ("analyst", ["porównaj", "analiza", "która lepsza", "oceń"]),
    ("narrator", ["opowiedz", "opisz", "jak tam", "atmosfera"]),
    ("feedback", ["nie podoba", "za mało", "za dużo", "zmień", "inaczej"]),
    ("lead", ["kontakt", "email", "telefon", "zadzwoń"]),
]
CHOICE_WORDS = [
    (0, ["pierwsz", "1.", "ta pierwsza", "numer 1", "opcja 1"]),
    (1, ["drug", "2.", "ta druga", "numer 2", "opcja 2"]),
    (2, ["trzeci", "3.", "ta trzecia", "numer 3", "opcja 3"]),
]
LIKED_WORDS = [
    ("las", "nature"),
    ("cisz", "quiet"),
    ("spok", "quiet"),
    ("ziel", "nature"),
    ("szkoł", "schools"),
    ("sklep", "shops"),
    ("przystane", "transport"),
    ("dojazd", "accessibility"),
    ("duż", "size"),
]
REQUIREMENT_WORDS = [
    ("larger", ["za mał", "mniejsza"]),
    ("smaller", ["za duż"]),
    ("cheaper", ["za drogie", "budżet", "tańsze"]),
    ("quieter", ["za głośn", "hałas"]),
]
DISLIKED_WORDS = [("distance", ["za daleko"])]
STYLE_WORDS = {
    "jargon": ["mpzp", "pog", "strefa", "zabudowa", "kondygnacja", "użytkowa"],
    "investment": ["inwestycja", "zwrot", "roi", "wynajem", "flipować"],
    "nature": ["las", "natura", "zieleń", "cisza", "spokój", "cicho"],
    "data": ["statystyki", "dane", "liczby", "konkretnie", "dokładnie"],
}
LOCATION_PREFIXES = [
    "okolice ", "okolica ", "gmina ", "miasto ", "m. ", "dzielnica ", "rejon ", "w ", "na ", "blisko ", "centrum ",
]
# unofficial name -> (city, districts to search, note)
DISTRICT_ALIASES = {
    "matemblewo": ("Gdańsk", ["Matarnia", "Osowa"], "obszar przy TPK"),
    "vii dwór": ("Gdańsk", ["Oliwa", "Wrzeszcz"], "część Oliwy"),
    "śródmieście": ("Gdańsk", ["Stare Miasto", "Dolne Miasto"], "centrum"),
    "ujeścisko-łostowice": ("Gdańsk", ["Łostowice", "Ujeścisko"], "nowa dzielnica"),
    "chwarzno-wiczlino": ("Gdynia", ["Wiczlino", "Chwarzno"], "nowa dzielnica"),
    "działki leśne": ("Gdynia", ["Redłowo", "Mały Kack"], "obszar leśny"),
    "dolny sopot": ("Sopot", None, "centrum Sopotu"),
    "górny sopot": ("Sopot", None, "wyższa część"),
    "karlikowo": ("Sopot", None, "luksusowa część"),
    "kamienny potok": ("Sopot", None, "spokojna część"),
    "brodwino": ("Sopot", None, "zachodnia część"),
}

# ---- fixed values: graph identifiers ----
OWNER_GROUP_IDS = {
    "Osoby fizyczne": "osoby_fizyczne",
    "Gminy (własność)": "gminy_wlasnosc",
    "Gminy (w zarządzie)": "gminy_zarzad",
    "Skarb Państwa": "skarb_panstwa",
    "Skarb Państwa (w zarządzie)": "skarb_panstwa_zarzad",
    "Inne podmioty publiczne": "inne_publiczne",
    "Województwa (własność)": "wojewodztwa_wlasnosc",
    "Województwa (w zarządzie)": "wojewodztwa_zarzad",
    "Powiaty (własność)": "powiaty_wlasnosc",
    "Powiaty (w zarządzie)": "powiaty_zarzad",
    "Spółdzielnie": "spoldzielnie",
    "Spółki Skarbu Państwa": "spolki_sp",
    "Spółki komunalne": "spolki_komunalne",
    "Kościoły i związki wyznaniowe": "koscioly",
    "Inne": "inne",
}
FUNCTION_IDS = {
    "mieszkalne": "mieszkalne",
    "gospodarcze": "gospodarcze",
    "handlowo-usługowe": "handlowo-uslugowe",
    "biurowe": "biurowe",
    "przemysłowe": "przemyslowe",
    "magazynowe": "magazynowe",
    "transport": "transport",
    "edukacja/kultura": "edukacja_kultura",
    "zdrowie": "zdrowie",
    "inne": "inne",
}
# alias id -> (name, district it stands for, city, districts to search)
LOCATION_ALIASES = {
    "matemblewo": ("Matemblewo", "Matarnia", "Gdańsk", ["Matarnia", "Osowa"]),
    "vii_dwor": ("VII Dwór", None, "Gdańsk", ["Oliwa", "Wrzeszcz"]),
    "vii_dwór": ("VII Dwór", None, "Gdańsk", ["Oliwa", "Wrzeszcz"]),
    "chwarzno": ("Chwarzno", "Chwarzno-Wiczlino", "Gdynia", ["Chwarzno-Wiczlino"]),
    "mateblewo": ("Matemblewo", "Matarnia", "Gdańsk", ["Matarnia"]),
    "trojmiasto": ("Trójmiasto", None, None, []),
}

# ---- fixed values: names users give to categories: id, kind, canonical name, variants, values ----
CATEGORY_NAMES = [
    ("cicha", "quietness", "Cicha okolica", ["cicha", "cicho", "spokojna", "spokojnie", "spokój", "cisza", "quiet", "peaceful"], ["bardzo_cicha", "cicha"]),
    ("bardzo_cicha", "quietness", "Bardzo cicha okolica", ["bardzo cicha", "super cicha", "idealna cisza", "kompletna cisza", "totalny spokój"], ["bardzo_cicha"]),
    ("umiarkowana_cisza", "quietness", "Umiarkowana cisza", ["umiarkowanie cicha", "średnio cicha", "niezbyt głośna", "w miarę spokojna"], ["umiarkowana"]),
    ("glosna", "quietness", "Głośna okolica", ["głośna", "głośno", "hałaśliwa", "hałas", "ruchliwa", "tętniąca życiem", "noisy"], ["glosna"]),
    ("zielona", "nature", "Zielona okolica", ["zielona", "zielono", "blisko natury", "naturalna", "przyroda", "green", "nature"], ["bardzo_zielona", "zielona"]),
    ("blisko_lasu", "nature", "Blisko lasu", ["blisko lasu", "przy lesie", "obok lasu", "las", "leśna", "forest", "lasy"], ["bardzo_zielona", "zielona"]),
    ("zurbanizowana", "nature", "Zurbanizowana", ["zurbanizowana", "miejska", "miasto", "urban", "bez natury", "beton"], ["zurbanizowana"]),
    ("dobry_dojazd", "accessibility", "Dobry dojazd", ["dobry dojazd", "łatwy dojazd", "blisko komunikacji", "dobrze skomunikowana", "transport"], ["doskonala", "dobra"]),
    ("blisko_szkoly", "accessibility", "Blisko szkoły", ["blisko szkoły", "przy szkole", "dla dzieci", "szkoła w pobliżu", "edukacja"], ["doskonala", "dobra"]),
    ("blisko_sklepu", "accessibility", "Blisko sklepu", ["blisko sklepu", "sklep w pobliżu", "przy sklepie", "zakupy", "market"], ["doskonala", "dobra"]),
    ("odlegla", "accessibility", "Odległa", ["odległa", "daleko od wszystkiego", "na uboczu", "zaciszna", "remote"], ["ograniczona"]),
    ("rzadka_zabudowa", "density", "Rzadka zabudowa", ["rzadka zabudowa", "mało domów", "przestronnie", "duże działki", "niezbyt zabudowane"], ["rzadka", "bardzo_rzadka"]),
    ("gesta_zabudowa", "density", "Gęsta zabudowa", ["gęsta zabudowa", "dużo domów", "osiedle", "zabudowana", "dense"], ["gesta"]),
    ("morze", "water", "Morze Bałtyckie", ["morze", "Bałtyk", "ocean", "plaża", "beach", "nad morzem", "przy morzu", "blisko morza", "morski", "sea"], ["morze"]),
    ("jezioro", "water", "Jezioro", ["jezioro", "jezior", "lake", "nad jeziorem", "przy jeziorze", "blisko jeziora"], ["jezioro"]),
    ("rzeka", "water", "Rzeka", ["rzeka", "rzeki", "river", "nad rzeką", "przy rzece", "blisko rzeki"], ["rzeka"]),
    ("zatoka", "water", "Zatoka", ["zatoka", "bay", "zatoka gdańska", "blisko zatoki"], ["zatoka"]),
    ("kanal", "water", "Kanał", ["kanał", "kanal", "canal", "przy kanale"], ["kanal"]),
    ("staw", "water", "Staw/Oczko wodne", ["staw", "oczko", "oczko wodne", "pond", "przy stawie"], ["staw"]),
    ("woda_ogolnie", "water", "Blisko wody", ["woda", "blisko wody", "przy wodzie", "nad wodą", "water", "waterfront"], ["jezioro"]),
    ("edukacja", "poi", "Placówka edukacyjna", ["szkoła", "przedszkole", "żłobek", "edukacja", "school", "dla dzieci", "szkoła podstawowa", "gimnazjum", "liceum"], ["school", "kindergarten"]),
    ("sklepy", "poi", "Sklepy", ["sklep", "market", "supermarket", "zakupy", "shop", "biedronka", "lidl", "żabka", "spożywczy", "shopping"], ["shop", "supermarket"]),
    ("komunikacja", "poi", "Komunikacja publiczna", ["przystanek", "autobus", "tramwaj", "SKM", "komunikacja", "transport", "bus_stop", "public_transport", "metro"], ["bus_stop"]),
    ("zdrowie", "poi", "Placówki medyczne", ["szpital", "przychodnia", "lekarz", "zdrowie", "hospital", "apteka", "clinic", "medical"], ["hospital", "doctors", "pharmacy"]),
    ("przemysl", "poi", "Tereny przemysłowe", ["przemysł", "fabryka", "zakład", "industrial", "hałas przemysłowy", "strefa przemysłowa"], ["industrial"]),
]
RESOLVE_THRESHOLDS = {"quietness": 0.6, "nature": 0.6, "accessibility": 0.6, "density": 0.6, "water": 0.5, "poi": 0.5}
