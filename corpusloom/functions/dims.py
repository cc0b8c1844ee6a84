"""Constants of the legal domain. They must be these for right results."""

from __future__ import annotations

#: Parliament's terms: number, first year, first year after.
LEGISLATURES = [
    (1, 1948, 1953),
    (2, 1953, 1958),
    (3, 1958, 1963),
    (4, 1963, 1968),
    (5, 1968, 1972),
    (6, 1972, 1976),
    (7, 1976, 1979),
    (8, 1979, 1983),
    (9, 1983, 1987),
    (10, 1987, 1992),
    (11, 1992, 1994),
    (12, 1994, 1996),
    (13, 1996, 2001),
    (14, 2001, 2006),
    (15, 2006, 2008),
    (16, 2008, 2013),
    (17, 2013, 2018),
    (18, 2018, 2022),
    (19, 2022, 2027),
]
#: From this year on, the term after the last.
OPEN_TERM = (20, 2027)

#: Cabinets in order of precedence: name, first year, first year after. They overlap; the first match counts.
CABINETS = [
    ("De Gasperi", 1948, 1953),
    ("Alcide De Gasperi", 1948, 1953),
    ("Pella", 1953, 1954),
    ("Fanfani", 1954, 1955),
    ("Segni", 1955, 1957),
    ("Zoli", 1957, 1958),
    ("Fanfani II", 1958, 1959),
    ("Segni II", 1959, 1960),
    ("Tambroni", 1960, 1960),
    ("Fanfani III", 1960, 1963),
    ("Leone", 1963, 1968),
    ("Moro", 1963, 1968),
    ("Rumor", 1968, 1970),
    ("Rumor II", 1970, 1972),
    ("Andreotti", 1972, 1973),
    ("Malfatti", 1972, 1973),
    ("Rumor III", 1973, 1974),
    ("Moro II", 1974, 1976),
    ("Andreotti II", 1976, 1979),
    ("Cossiga", 1979, 1980),
    ("Cossiga II", 1980, 1981),
    ("Spadolini", 1981, 1982),
    ("Spadolini II", 1982, 1983),
    ("Fanfani IV", 1983, 1987),
    ("Craxi", 1983, 1987),
    ("Andreotti III", 1989, 1992),
    ("Amato", 1992, 1993),
    ("Ciampi", 1993, 1994),
    ("Berlusconi", 1994, 1995),
    ("Berlusconi I", 1994, 1995),
    ("Dini", 1995, 1996),
    ("Prodi", 1996, 2000),
    ("D'Alema", 1998, 2000),
    ("Amato II", 2000, 2001),
    ("Berlusconi II", 2001, 2006),
    ("Prodi II", 2006, 2008),
    ("Berlusconi III", 2008, 2011),
    ("Berlusconi IV", 2011, 2012),
    ("Monti", 2011, 2012),
    ("Letta", 2013, 2014),
    ("Renzi", 2014, 2016),
    ("Gentiloni", 2016, 2018),
    ("Conte", 2018, 2021),
    ("Draghi", 2021, 2022),
    ("Meloni", 2022, 2024),
]

#: Eras: first year after, label. Later years have the last label.
ERAS = [
    (1960, "Early Republic (1948-1960)"),
    (1980, "First Republic I (1960-1980)"),
    (2000, "First Republic II (1980-2000)"),
    (2010, "Second Republic I (2000-2010)"),
    (2020, "Second Republic II (2010-2020)"),
]
LAST_ERA = "Recent (2020+)"

#: Spellings of the two statuses.
IN_FORCE = ["in_force", "vigente", "v", "in force", "active"]
ABROGATED = ["abrogated", "abrogato", "abrogata", "a", "repealed"]

#: Short forms of act types and the types of their URNs.
ACT_TYPES = {
    "legge": "legge",
    "l": "legge",
    "decreto": "decreto",
    "decr": "decreto",
    "d.lgs": "decreto.legislativo",
    "d.l": "decreto.legge",
    "dpr": "decreto.del.presidente.della.repubblica",
    "d.p.r": "decreto.del.presidente.della.repubblica",
    "dpcm": "decreto.del.presidente.del.consiglio.dei.ministri",
    "d.p.c.m": "decreto.del.presidente.del.consiglio.dei.ministri",
    "d.m": "decreto.ministeriale",
    "r.d": "regio.decreto",
    "l.cost": "legge.costituzionale",
}
MONTHS = ["gennaio", "febbraio", "marzo", "aprile", "maggio", "giugno", "luglio", "agosto", "settembre", "ottobre", "novembre", "dicembre"]

#: Words that show an act's domain, in order of precedence.
DOMAINS = {
    "diritto_penale": ["reato", "pena", "reclusione", "delitto", "contravvenzione", "penale"],
    "diritto_civile": ["contratto", "obbligazione", "proprietà", "possesso", "civile"],
    "diritto_lavoro": ["lavoratore", "datore", "rapporto di lavoro", "licenziamento", "retribuzione"],
    "diritto_amministrativo": ["pubblica amministrazione", "procedimento", "provvedimento", "autorità"],
    "diritto_tributario": ["imposta", "tributo", "fiscale", "contribuente", "reddito", "iva"],
    "diritto_sanitario": ["salute", "sanitario", "medico", "ospedale", "farmaco", "vaccino"],
    "diritto_ambientale": ["ambiente", "inquinamento", "rifiuti", "ecologia", "emissioni"],
    "diritto_europeo": ["unione europea", "direttiva", "regolamento ue", "trattato"],
    "diritto_costituzionale": ["costituzione", "costituzionale", "diritti fondamentali", "referendum"],
    "protezione_civile": ["protezione civile", "emergenza", "calamità", "stato di emergenza"],
    "edilizia_urbanistica": ["edilizia", "urbanistica", "costruzione", "concessione edilizia"],
    "trasporti": ["trasporto", "circolazione", "stradale", "navigazione", "aviazione"],
}

#: Words that show a tax.
TAXES = {
    "IVA": ["iva", "imposta sul valore aggiunto"],
    "IRPEF": ["irpef", "imposta sul reddito delle persone fisiche"],
    "IRES": ["ires", "imposta sul reddito delle societa", "imposta sul reddito delle società"],
    "IMU": ["imu", "imposta municipale propria"],
    "TARI": ["tari", "tassa sui rifiuti"],
    "TASI": ["tasi", "tributo per i servizi indivisibili"],
    "Bollo": ["imposta di bollo", "bollo auto", "bollo"],
    "Registro": ["imposta di registro"],
    "Accise": ["accisa", "accise"],
    "Canone RAI": ["canone rai", "canone televisivo"],
    "Contributi Previdenziali": ["contributi previdenziali", "contributo inps", "inps"],
    "Addizionale Regionale": ["addizionale regionale"],
    "Addizionale Comunale": ["addizionale comunale"],
    "Imposta di Successione": ["imposta sulle successioni", "imposta di successione"],
    "Imposta Ipotecaria/Catastale": ["imposta ipotecaria", "imposta catastale"],
}

#: Files of the full history for one file of the current text, by collection; others 2.0.
HISTORY_RATIOS = {"Codici": 41.17, "Leggi costituzionali": 2.86, "Leggi di delegazione europea": 5.82, "Atti di attuazione": 2.69, "Varie": 2.0}
