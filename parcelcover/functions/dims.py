"""Reference tables: land-cover types and their classes, habitat codes, zones, labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The 26 land-cover types by main group.
MAIN_GROUPS = {
    "Gebäude": ["Gebaeude"],
    "Befestigt": ["Strasse_Weg", "Trottoir", "Verkehrsinsel", "Bahn", "Flugplatz", "Wasserbecken", "uebrige_befestigte"],
    "Humusiert": ["Acker_Wiese_Weide", "Reben", "uebrige_Intensivkultur", "Gartenanlage", "Hoch_Flachmoor", "uebrige_humusierte"],
    "Gewässer": ["Gewaesser_stehendes", "Gewaesser_fliessendes", "Schilfguertel"],
    "Bestockt": ["geschlossener_Wald", "Wytweide_dicht", "Wytweide_offen", "uebrige_bestockte"],
    "Vegetationslos": ["Fels", "Gletscher_Firn", "Geroell_Sand", "Abbau_Deponie", "uebrige_vegetationslose"],
}
MAIN_OF = {a: m for m, arts in MAIN_GROUPS.items() for a in arts}
ARTS = list(MAIN_OF)
# Names of the types in German, French and Italian; of the main groups; types and names of the subgroups.
ART_NAMES = {
    "Gebaeude": ("Gebäude", "Bâtiment", "Edificio"),
    "Strasse_Weg": ("Strasse/Weg", "Route, chemin", "Strada, sentiero"),
    "Trottoir": ("Trottoir", "Trottoir", "Marciapiede"),
    "Verkehrsinsel": ("Verkehrsinsel", "Îlot", "Aiuola spartitraffico"),
    "Bahn": ("Bahn", "Chemin de fer", "Ferrovia"),
    "Flugplatz": ("Flugplatz", "Place d'aviation", "Aerodromo"),
    "Wasserbecken": ("Wasserbecken", "Bassin", "Bacino"),
    "uebrige_befestigte": ("Übrige befestigte", "Autre surface stabilisée", "Altra superficie consolidata"),
    "Acker_Wiese_Weide": ("Acker/Wiese/Weide", "Champ, pré, pâturage", "Campo, prato, pascolo"),
    "Reben": ("Reben", "Vigne", "Vigna"),
    "uebrige_Intensivkultur": ("Übrige Intensivkultur", "Autre culture intensive", "Altra coltura intensiva"),
    "Gartenanlage": ("Gartenanlage", "Jardin", "Giardino"),
    "Hoch_Flachmoor": ("Hoch-/Flachmoor", "Haut-marais, bas-marais", "Torbiera alta e bassa"),
    "uebrige_humusierte": ("Übrige humusierte", "Autre surface à sol naturel", "Altra superficie con terreno umifero"),
    "Gewaesser_stehendes": ("Stehendes Gewässer", "Eau stagnante", "Acqua stagnante"),
    "Gewaesser_fliessendes": ("Fliessendes Gewässer", "Eau courante", "Acqua corrente"),
    "Schilfguertel": ("Schilfgürtel", "Roselière", "Canneto"),
    "geschlossener_Wald": ("Geschlossener Wald", "Forêt dense", "Bosco fitto"),
    "Wytweide_dicht": ("Wytweide (dicht)", "Pâturage boisé dense", "Pascolo alberato denso"),
    "Wytweide_offen": ("Wytweide (offen)", "Pâturage boisé ouvert", "Pascolo alberato rado"),
    "uebrige_bestockte": ("Übrige bestockte", "Autre surface boisée", "Altra superficie boschiva"),
    "Fels": ("Fels", "Rocher", "Roccia"),
    "Gletscher_Firn": ("Gletscher/Firn", "Glacier, névé", "Ghiacciaio, nevaio"),
    "Geroell_Sand": ("Geröll/Sand", "Éboulis, sable", "Detriti, sabbia"),
    "Abbau_Deponie": ("Abbau/Deponie", "Extraction, décharge", "Estrazione, discarica"),
    "uebrige_vegetationslose": ("Übrige vegetationslose", "Autre surface sans végétation", "Altra superficie senza vegetazione"),
}
MAIN_NAMES = {
    "Gebäude": ("Bâtiment", "Edificio"),
    "Befestigte Flächen": ("Surfaces revêtues", "Superfici pavimentate"),
    "Humusierte Flächen": ("Surfaces à sol naturel", "Superfici con terreno umifero"),
    "Gewässer": ("Eaux", "Acque"),
    "Bestockte Flächen": ("Surfaces boisées", "Superfici boschive"),
    "Vegetationslose Flächen": ("Surfaces sans végétation", "Superfici senza vegetazione"),
}
SUBGROUPS = {
    "Intensivkultur": (["Reben", "uebrige_Intensivkultur"], "Culture intensive", "Coltura intensiva"),
    "Wytweide": (["Wytweide_dicht", "Wytweide_offen"], "Pâturage boisé", "Pascolo alberato"),
}
# Classes by type.
SEALED = {"Gebaeude", *MAIN_GROUPS["Befestigt"]}
GREEN_SOIL = {"Acker_Wiese_Weide", "Reben", "Gartenanlage", "Hoch_Flachmoor", "uebrige_humusierte", "Wytweide_dicht", "Wytweide_offen"}
GREEN_WOODED = {"geschlossener_Wald", "uebrige_bestockte"}
WORKED = (SEALED - {"Gebaeude"}) | {"Acker_Wiese_Weide", "Reben", "uebrige_Intensivkultur", "Gartenanlage", "Hoch_Flachmoor", "uebrige_humusierte", "Wytweide_dicht", "Wytweide_offen"}
KAT_B = {"Acker_Wiese_Weide", "Reben", "uebrige_Intensivkultur", "Gartenanlage", "uebrige_humusierte", "Wytweide_dicht", "Wytweide_offen"}
BARE = {"Fels", "Gletscher_Firn", "Geroell_Sand"}
SOIL, WOODED, NOT_GREEN = "Green space (soil-covered)", "Green space (wooded)", "Not green space"

ART_COLUMNS = "art string, maingroup string, sia416 string, din277 string, greenspace string, sealed boolean, vbs_kat string, vbs_produktiv string, vbs_typ string"


def art_row(art: str) -> tuple:
    """A type's classes."""
    sia = "GGF" if art == "Gebaeude" else "BUF" if art in WORKED else "UUF"
    green = SOIL if art in GREEN_SOIL else WOODED if art in GREEN_WOODED else NOT_GREEN
    kat = "kat_a" if art in SEALED or art == "Abbau_Deponie" else "kat_b" if art in KAT_B else "kat_c" if art in GREEN_WOODED else "kat_d"
    productive = kat != "kat_a" and art not in BARE
    typ = ("typ1" if art == "Gartenanlage" else "typ2") if productive else None
    return art, MAIN_OF[art], sia, "BF" if art == "Gebaeude" else "UF", green, art in SEALED, kat, "produktiv" if productive else "unproduktiv", typ


#: What a type outside the list counts as.
UNKNOWN = {"sia416": "UUF", "din277": "UF", "greenspace": NOT_GREEN, "sealed": False, "vbs_kat": "kat_d", "vbs_produktiv": "unproduktiv"}

# Habitat classes by first digit, then codes that differ from their class: name, green, category, productive, type.
HABITAT_L1 = {
    "1": ("Gewässer", NOT_GREEN, "kat_d", "produktiv", "typ2"),
    "2": ("Ufer & Feuchtgebiete", SOIL, "kat_d", "produktiv", "typ2"),
    "3": ("Gletscher, Fels, Schutt, Geröll", NOT_GREEN, "kat_d", "unproduktiv", None),
    "4": ("Grünland", SOIL, "kat_b", "produktiv", "typ2"),
    "5": ("Krautsäume, Hochstauden, Gebüsche", WOODED, "kat_c", "produktiv", "typ2"),
    "6": ("Wälder", WOODED, "kat_c", "produktiv", "typ2"),
    "7": ("Pionier-/Ruderalvegetation", NOT_GREEN, "kat_d", "produktiv", "typ2"),
    "8": ("Pflanzungen, Äcker, Kulturen", SOIL, "kat_b", "produktiv", "typ2"),
    "9": ("Gebäude / Anlagen", NOT_GREEN, "kat_a", "unproduktiv", None),
}
HABITAT_FINER = {
    "1.3": (SOIL, "kat_c", "produktiv", "typ2"),
    "2.0": (NOT_GREEN, "kat_a", "unproduktiv", None),
    "4.0": (SOIL, "kat_a", "produktiv", "typ2"),
    "5.1": (SOIL, "kat_c", "produktiv", "typ2"),
    "5.2": (SOIL, "kat_c", "produktiv", "typ2"),
    "6.0": (WOODED, "kat_b", "produktiv", "typ2"),
    "7.2": (NOT_GREEN, "kat_a", "unproduktiv", None),
    "8.1": (WOODED, "kat_b", "produktiv", "typ2"),
}
# Names of habitat codes of levels 1 and 2. Finer ones come from a table of the user's (code, name).
HABITAT_NAMES = {
    "1": "Gewässer", "1.1": "Stehende Gewässer", "1.2": "Fliessgewässer", "1.3": "Quellen und Quellfluren", "1.4": "Unterirdische Gewässer",
    "2": "Ufer und Feuchtgebiete", "2.0": "Künstliche Ufer", "2.1": "Ufer mit Vegetation", "2.2": "Flachmoore", "2.3": "Feuchtwiesen", "2.4": "Hochmoore", "2.5": "Wechselfeuchte Pionierfluren",
    "3": "Gletscher, Fels, Schutt und Geröll", "3.1": "Gletscher, Firn- und Schneefleder", "3.2": "Alluvionen und Moränen", "3.3": "Steinschutt- und Geröllfluren", "3.4": "Felsen", "3.5": "Höhlen",
    "4": "Grünland (Naturrasen, Wiesen und Weiden)", "4.0": "Kunstrasen", "4.1": "Pionierfluren auf Felsböden (Felsgrusfluren)", "4.2": "Wärmeliebende Trockenrasen", "4.3": "Gebirgs-Magerrasen", "4.4": "Schneetälchen", "4.5": "Fettwiesen und -weiden", "4.6": "Grasbrachen",
    "5": "Krautsäume, Hochstaudenfluren und Gebüsche", "5.1": "Krautsäume", "5.2": "Hochstauden- und Schlagfluren", "5.3": "Gebüsche", "5.4": "Zwergstrauchheiden",
    "6": "Wälder", "6.0": "Forstpflanzungen", "6.1": "Bruch- und Auenwälder", "6.2": "Buchenwälder", "6.3": "Andere Laubwälder", "6.4": "Wärmeliebende Föhrenwälder", "6.5": "Hochmoorwälder", "6.6": "Gebirgsnadelwälder",
    "7": "Pioniervegetation gestörter Plätze (Ruderalstandorte)", "7.1": "Trittrasen und Ruderalfluren", "7.2": "Anthropogene Steinfluren",
    "8": "Pflanzungen, Äcker und Kulturen", "8.1": "Baumschulen, Obstgärten, Rebberge", "8.2": "Feldkulturen (Äcker)",
    "9": "Bauten, Anlagen", "9.1": "Lagerplätze, Deponien", "9.2": "Bauten", "9.3": "Verkehrswege", "9.4": "Versiegeleter Sportplatz, Parkplatz etc.",
}
# Habitat code to land-cover type.
HABITAT_TO_ART = {
    "1": "Gewaesser_stehendes", "2": "Hoch_Flachmoor", "3": "Geroell_Sand", "4": "Acker_Wiese_Weide", "5": "uebrige_bestockte", "6": "geschlossener_Wald",
    "7": "uebrige_vegetationslose", "8": "Acker_Wiese_Weide", "9": "uebrige_befestigte", "9.2": "Gebaeude", "9.3.2": "Strasse_Weg", "9.0.2": "uebrige_befestigte", "9.3.3": "uebrige_vegetationslose",
}
# First digits of near-natural habitats.
NATURAL_DIGITS = "1234567"
# Zones with their relevance, and labels of codes.
ZONES = {
    "wohnzonen": ("Wohnzonen", 0.6), "arbeitszonen": ("Arbeitszonen", 1.0), "mischzonen": ("Mischzonen", 0.75), "zentrumszonen": ("Zentrumszonen", 0.9),
    "zonen_fuer_oeffentliche_nutzungen": ("Zonen für öffentliche Nutzungen", 1.0), "eingeschraenkte_bauzonen": ("eingeschränkte Bauzonen", 0.5),
    "tourismus_und_freizeitzonen": ("Tourismus- und Freizeitzonen", 0.7), "verkehrszonen_innerhalb_der_bauzonen": ("Verkehrszonen innerhalb der Bauzonen", 0.3), "weitere_bauzonen": ("weitere Bauzonen", 0.4),
}
NO_ZONE = "ohne_bauzone"
PORTFOLIO = {"1": "Allgemeine Bundesverwaltung", "2": "Ausland", "3": "Zoll", "4": "Gerichte", "5": "Forschungsanstalten", "6": "Kunst und Kultur", "7": "Sport", "8": "Repräsentation Inland", "9": "Infrastruktur"}
OWNERSHIP = {"1": "Eigentum Bund", "3": "Anmiete", "5": "Spezialfall"}
STATUS = {"found": "Gefunden", "merged": "Gefunden (zusammengeführt)", "not_found": "Nicht gefunden", "invalid": "Ungültige E-GRID", "error": "Fehler"}
VBS_LABELS = {
    "kat_a": "A. Settlement area", "kat_b": "B. Agricultural area", "kat_c": "C. Wooded area", "kat_d": "D. Unproductive area",
    "produktiv": "1 Biologically productive", "unproduktiv": "2 Biologically unproductive", "typ1": "Type 1 - Green spaces near buildings", "typ2": "Type 2 - Other green spaces",
}
#: Habitat columns of the portfolio bridge.
HABITAT_SLUGS = ["9_2", "9_3", "1_3", "4_0", "6_0", "6"]
# Fixed values. Excluded by name: start of the name, or a word of its own.
EXCLUDE = [("ABGA", "prefix"), ("LÖVM", "prefix"), ("PP", "word")]
KPIS = (
    "sia416_ggf_m2 sia416_buf_m2 sia416_uuf_m2 din277_bf_m2 din277_uf_m2 sealed_m2 greenspace_m2 vbs_produktiv_m2 vbs_unproduktiv_m2 "
    "vbs_kat_a_m2 vbs_kat_b_m2 vbs_kat_c_m2 vbs_kat_d_m2 vbs_typ1_m2 vbs_typ2_m2"
).split()
# User columns that stay.
INPUT_KEPT = ["ort", "plz", "rg", "bez. grundstück", "eigent.art", "tpf", "l/r"]


def dim_art(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([art_row(a) for a in ARTS], ART_COLUMNS)


def dim_names(spark: SparkSession) -> DataFrame:
    """(art, maingroup, subgroup, de, fr, it, maingroup_de, maingroup_fr, maingroup_it) of the types; blank without subgroup."""
    sub = {a: s for s, (arts, _, _) in SUBGROUPS.items() for a in arts}
    main = dict(zip(MAIN_GROUPS, MAIN_NAMES.items(), strict=True))
    rows = [(a, MAIN_OF[a], sub.get(a, ""), *ART_NAMES[a], main[MAIN_OF[a]][0], *main[MAIN_OF[a]][1]) for a in ARTS]
    return spark.createDataFrame(rows, "art string, maingroup string, subgroup string, de string, fr string, it string, maingroup_de string, maingroup_fr string, maingroup_it string")


def dim_habitat(spark: SparkSession, finer: DataFrame | None = None) -> DataFrame:
    """(code, level, name): habitat names of levels 1 and 2, and those of a table (code, name) of finer ones."""
    names = spark.createDataFrame([*HABITAT_NAMES.items()], "code string, name string")
    if finer is not None:
        names = names.unionByName(finer.select("code", "name"))
    return names.withColumn("level", F.size(F.split("code", r"\."))).select("code", "level", "name")


def country_names(names: DataFrame, code: str, table: DataFrame) -> DataFrame:
    """names with country: the name of a country code by a table (code, name), some hundred rows given by the user; codes
    that it doesn't have stay, in capitals or not; blank is a dash."""
    known = F.broadcast(table.select(F.upper("code").alias("__code"), F.col("name").alias("country")))
    out = names.join(known, F.upper(F.col(code).cast("string")) == F.col("__code"), "left").drop("__code")
    blank = F.coalesce(F.col(code).cast("string"), F.lit("")) == ""
    return out.withColumn("country", F.when(blank, "—").otherwise(F.coalesce("country", F.col(code).cast("string"))))
