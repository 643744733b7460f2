"""Fixed vocabularies of the catalogue. All tables here are fixed values, in their fixed order: results depend on both."""

from __future__ import annotations

#: Id, label, short label.
MISSIONS = [
    ("comms", "Communications", "Comms"),
    ("military", "Military & intelligence", "Military"),
    ("eo", "Earth observation & weather", "Earth obs."),
    ("nav", "Navigation (GNSS)", "Navigation"),
    ("human", "Human spaceflight", "Crewed"),
    ("science", "Science", "Science"),
    ("tech", "Technology & other", "Tech/other"),
]
#: Id, label, short label. OT is the rest of the world.
BLOCS = [
    ("US", "United States", "US"),
    ("CN", "China", "China"),
    ("EU", "Europe", "Europe"),
    ("RU", "Russia", "Russia"),
    ("JP", "Japan", "Japan"),
    ("IN", "India", "India"),
    ("KR", "South Korea", "S. Korea"),
    ("OT", "Rest of world", "Other"),
]
#: Id, label, range.
REGIMES = [
    ("LEO", "Low Earth orbit", "< 2,000 km"),
    ("MEO", "Medium Earth orbit", "2,000 – 35,000 km"),
    ("GEO", "Geostationary", "≈ 35,786 km"),
    ("HEO", "Highly elliptical", "eccentric / beyond GEO"),
]
#: Id, label.
SECTORS = [
    ("commercial", "Commercial"),
    ("civil", "Civil government"),
    ("military", "Military"),
    ("academic", "Academic & amateur"),
    ("unknown", "Unknown"),
]
#: Code, name, bloc.
COUNTRIES = [
    ("US", "United States", "US"),
    ("CN", "China", "CN"),
    ("HK", "Hong Kong (China)", "CN"),
    ("RU", "Russia", "RU"),
    ("JP", "Japan", "JP"),
    ("IN", "India", "IN"),
    ("KR", "South Korea", "KR"),
    ("EU", "European agencies (ESA/EU/EUMETSAT)", "EU"),
    ("GB", "United Kingdom", "EU"),
    ("FR", "France", "EU"),
    ("DE", "Germany", "EU"),
    ("IT", "Italy", "EU"),
    ("ES", "Spain", "EU"),
    ("LU", "Luxembourg", "EU"),
    ("FI", "Finland", "EU"),
    ("NL", "Netherlands", "EU"),
    ("BE", "Belgium", "EU"),
    ("NO", "Norway", "EU"),
    ("SE", "Sweden", "EU"),
    ("DK", "Denmark", "EU"),
    ("PT", "Portugal", "EU"),
    ("PL", "Poland", "EU"),
    ("GR", "Greece", "EU"),
    ("CH", "Switzerland", "EU"),
    ("AT", "Austria", "EU"),
    ("CZ", "Czechia", "EU"),
    ("HU", "Hungary", "EU"),
    ("SK", "Slovakia", "EU"),
    ("SI", "Slovenia", "EU"),
    ("LT", "Lithuania", "EU"),
    ("LV", "Latvia", "EU"),
    ("EE", "Estonia", "EU"),
    ("RO", "Romania", "EU"),
    ("BG", "Bulgaria", "EU"),
    ("HR", "Croatia", "EU"),
    ("IE", "Ireland", "EU"),
    ("MC", "Monaco", "EU"),
    ("UA", "Ukraine", "EU"),
    ("BY", "Belarus", "OT"),
    ("ME", "Montenegro", "EU"),
    ("CA", "Canada", "OT"),
    ("AU", "Australia", "OT"),
    ("NZ", "New Zealand", "OT"),
    ("TW", "Taiwan", "OT"),
    ("TR", "Türkiye", "OT"),
    ("AE", "United Arab Emirates", "OT"),
    ("SA", "Saudi Arabia", "OT"),
    ("IL", "Israel", "OT"),
    ("IR", "Iran", "OT"),
    ("BR", "Brazil", "OT"),
    ("AR", "Argentina", "OT"),
    ("MX", "Mexico", "OT"),
    ("UY", "Uruguay", "OT"),
    ("CL", "Chile", "OT"),
    ("PE", "Peru", "OT"),
    ("EC", "Ecuador", "OT"),
    ("BO", "Bolivia", "OT"),
    ("VE", "Venezuela", "OT"),
    ("SG", "Singapore", "OT"),
    ("ID", "Indonesia", "OT"),
    ("TH", "Thailand", "OT"),
    ("MY", "Malaysia", "OT"),
    ("PH", "Philippines", "OT"),
    ("VN", "Vietnam", "OT"),
    ("LA", "Laos", "OT"),
    ("BD", "Bangladesh", "OT"),
    ("PK", "Pakistan", "OT"),
    ("KZ", "Kazakhstan", "OT"),
    ("AZ", "Azerbaijan", "OT"),
    ("MN", "Mongolia", "OT"),
    ("KP", "North Korea", "OT"),
    ("EG", "Egypt", "OT"),
    ("DZ", "Algeria", "OT"),
    ("MA", "Morocco", "OT"),
    ("TN", "Tunisia", "OT"),
    ("NG", "Nigeria", "OT"),
    ("ZA", "South Africa", "OT"),
    ("RW", "Rwanda", "OT"),
    ("AO", "Angola", "OT"),
    ("BW", "Botswana", "OT"),
    ("DJ", "Djibouti", "OT"),
    ("MU", "Mauritius", "OT"),
    ("QA", "Qatar", "OT"),
    ("KW", "Kuwait", "OT"),
    ("BH", "Bahrain", "OT"),
    ("JO", "Jordan", "OT"),
    ("PG", "Papua New Guinea", "OT"),
    ("SB", "Solomon Islands", "OT"),
    ("INT", "International organisation", "OT"),
    ("XX", "Unknown", "OT"),
]
#: Id, label, operator, description; in display order.
CONSTELLATIONS = [
    ("starlink", "Starlink", "SpaceX", "Broadband mega-constellation"),
    ("oneweb", "OneWeb", "Eutelsat OneWeb", "Broadband constellation, 1,200 km"),
    ("kuiper", "Amazon Leo (Kuiper)", "Amazon", "Broadband constellation"),
    ("qianfan", "Qianfan (Thousand Sails)", "Spacesail", "Chinese broadband constellation"),
    ("guowang", "Guowang (SatNet)", "China SatNet", "Chinese state broadband constellation"),
    ("iridium", "Iridium", "Iridium", "Global voice & data, polar orbits"),
    ("globalstar", "Globalstar", "Globalstar", "Mobile satellite services"),
    ("orbcomm", "ORBCOMM", "ORBCOMM", "IoT / M2M messaging"),
    ("o3b", "O3b mPOWER", "SES", "MEO broadband"),
    ("ast", "AST SpaceMobile", "AST SpaceMobile", "Direct-to-phone broadband"),
    ("gps", "GPS", "US Space Force", "US navigation system, 6 planes"),
    ("glonass", "GLONASS", "Roscosmos / VKS", "Russian navigation system"),
    ("galileo", "Galileo", "EUSPA / ESA", "European navigation system"),
    ("beidou", "BeiDou", "CNSA", "Chinese navigation system"),
    ("qzss", "QZSS (Michibiki)", "Japan Cabinet Office", "Japanese regional navigation"),
    ("navic", "NavIC (IRNSS)", "ISRO", "Indian regional navigation"),
    ("planet", "Planet Dove/SkySat", "Planet", "Daily Earth imaging"),
    ("spire", "Spire Lemur", "Spire", "Weather & ship/aircraft tracking"),
    ("jilin", "Jilin-1", "Chang Guang Satellite", "Chinese commercial imaging"),
    ("yaogan", "Yaogan", "PLA", "Chinese military reconnaissance"),
    ("iceye", "ICEYE", "ICEYE", "SAR radar imaging"),
    ("sda", "SDA Tranche", "Space Development Agency", "US military proliferated LEO"),
    ("stations", "Space station modules", "NASA · CMSA · partners", "ISS and Tiangong modules"),
]
#: Pattern over the upper-case name, constellation, operator, mission, country, sector. The first match wins.
NAME_RULES = [
    (r"^(ISS \(|ISS\z|ZARYA|ZVEZDA|NAUKA|POISK|UNITY|DESTINY)", "stations", "ISS partners (NASA · Roscosmos · ESA · JAXA · CSA)", "human", "US", "civil"),
    (r"^(CSS \(|TIANHE|WENTIAN|MENGTIAN|TIANGONG)", "stations", "China Manned Space Agency", "human", "CN", "civil"),
    (r"^(SHENZHOU|TIANZHOU)", None, "China Manned Space Agency", "human", "CN", "civil"),
    (r"^(SOYUZ|PROGRESS)", None, "Roscosmos", "human", "RU", "civil"),
    (r"^(CREW DRAGON|DRAGON|CRS-|CYGNUS|STARLINER|HTV|DREAM CHASER|AXIOM)", None, "NASA (commercial crew & cargo)", "human", "US", "civil"),
    (r"^STARLINK", "starlink", "SpaceX", "comms", "US", "commercial"),
    (r"^ONEWEB", "oneweb", "Eutelsat OneWeb", "comms", "GB", "commercial"),
    (r"^(KUIPER|AMAZON LEO)", "kuiper", "Amazon", "comms", "US", "commercial"),
    (r"^QIANFAN", "qianfan", "Spacesail (Shanghai)", "comms", "CN", "commercial"),
    (r"^(HULIANWANG|GUOWANG|SATNET)", "guowang", "China SatNet", "comms", "CN", None),
    (r"^IRIDIUM", "iridium", "Iridium", "comms", "US", "commercial"),
    (r"^GLOBALSTAR", "globalstar", "Globalstar", "comms", "US", "commercial"),
    (r"^ORBCOMM", "orbcomm", "ORBCOMM", "comms", "US", "commercial"),
    (r"^O3B", "o3b", "SES", "comms", "LU", "commercial"),
    (r"^(BLUEBIRD|BLUEWALKER|SPACEMOBILE)", "ast", "AST SpaceMobile", "comms", "US", "commercial"),
    (r"^(NAVSTAR|GPS )", "gps", "US Space Force", "nav", "US", "military"),
    (r"GLONASS", "glonass", "Russian Aerospace Forces (GLONASS)", "nav", "RU", "military"),
    (r"^GSAT0\d{3}|\(GALILEO", "galileo", "EUSPA / ESA (Galileo)", "nav", "EU", "civil"),
    (r"^BEIDOU", "beidou", "China Satellite Navigation Office", "nav", "CN", "military"),
    (r"^QZS-", "qzss", "Japan Cabinet Office (QZSS)", "nav", "JP", "civil"),
    (r"^(IRNSS|NVS-)", "navic", "ISRO", "nav", "IN", "civil"),
    (r"^(FLOCK|DOVE|SUPERDOVE|SKYSAT|PELICAN|TANAGER)", "planet", "Planet", "eo", "US", "commercial"),
    (r"^LEMUR", "spire", "Spire Global", "eo", "US", "commercial"),
    (r"^JILIN", "jilin", "Chang Guang Satellite", "eo", "CN", "commercial"),
    (r"^ICEYE", "iceye", "ICEYE", "eo", "FI", "commercial"),
    (r"^(CAPELLA)", None, "Capella Space", "eo", "US", "commercial"),
    (r"^(UMBRA)", None, "Umbra", "eo", "US", "commercial"),
    (r"^(SENTINEL)", None, "ESA / Copernicus", "eo", "EU", "civil"),
    (r"^(NOAA|GOES|JPSS|SUOMI)", None, "NOAA", "eo", "US", "civil"),
    (r"^(METEOSAT|METOP)", None, "EUMETSAT", "eo", "EU", "civil"),
    (r"^(FENGYUN)", None, "China Meteorological Administration", "eo", "CN", "civil"),
    (r"^(GAOFEN|ZIYUAN|HAIYANG|HUANJING)", None, "China (CNSA / SASTIND)", "eo", "CN", "civil"),
    (r"^(WORLDVIEW|LEGION|GEOEYE)", None, "Maxar Intelligence", "eo", "US", "commercial"),
    (r"^YAOGAN", "yaogan", "People's Liberation Army", "military", "CN", "military"),
    (r"SDA[_ ]|^TRANCHE|^(PRAETORIAN|CHECKMATE)", "sda", "Space Development Agency", "military", "US", "military"),
    (r"^(USA \d+|NROL|SBIRS|AEHF|WGS|MUOS|MILSTAR|DSCS|GSSAP)", None, "US Department of Defense", "military", "US", "military"),
    (r"^(COSMOS|KOSMOS)", None, "Russian Aerospace Forces", "military", "RU", "military"),
    (r"^(ANASIS|KORSAT|425 PROJECT)", None, "ROK Ministry of National Defense", "military", "KR", "military"),
    (r"^(SHIYAN|TJS|TONGXIN JISHU SHIYAN)", None, "China (experimental / PLA)", "military", "CN", "military"),
    (r"^(ARIRANG|KOMPSAT|CAS500|GEO-KOMPSAT)", None, "KARI (Korea Aerospace Research Institute)", "eo", "KR", "civil"),
    (r"^KOREASAT", None, "KT SAT", "comms", "KR", "commercial"),
    (r"^(NEONSAT|NEXTSAT|STSAT)", None, "KAIST SaTReC", None, "KR", "civil"),
]
#: Owner code of the registry -> country.
OWNER_COUNTRY = {
    "US": "US", "PRC": "CN", "CIS": "RU", "UK": "GB", "JPN": "JP", "IT": "IT", "IND": "IN", "FR": "FR", "ESA": "EU", "GER": "DE", "SKOR": "KR",
    "CA": "CA", "SPN": "ES", "TURK": "TR", "SES": "LU", "ITSO": "INT", "O3B": "LU", "AUS": "AU", "EUTE": "FR", "ARGN": "AR", "GLOB": "US",
    "ROC": "TW", "FIN": "FI", "UAE": "AE", "NOR": "NO", "GREC": "GR", "ISRA": "IL", "SAUD": "SA", "BRAZ": "BR", "IM": "GB", "ORB": "US", "POL": "PL",
    "IRAN": "IR", "SING": "SG", "LUXE": "LU", "POR": "PT", "BEL": "BE", "AB": "INT", "INDO": "ID", "EGYP": "EG", "EUME": "EU", "SWTZ": "CH",
    "THAI": "TH", "MALA": "MY", "PAKI": "PK", "RWA": "RW", "AC": "HK", "ALG": "DZ", "BUL": "BG", "TBD": "XX", "NETH": "NL", "DEN": "DK", "SWED": "SE",
    "MEX": "MX", "KAZ": "KZ", "AZER": "AZ", "VTNM": "VN", "NIG": "NG", "CHLE": "CL", "PER": "PE", "ECU": "EC", "BOL": "BO", "VENZ": "VE", "QAT": "QA",
    "KUWT": "KW", "BHR": "BH", "JOR": "JO", "NZ": "NZ", "SAFR": "ZA", "HUN": "HU", "CZCH": "CZ", "SVK": "SK", "SVN": "SI", "LTU": "LT", "LAOS": "LA",
    "BGD": "BD", "MNG": "MN", "NKOR": "KP", "TUN": "TN", "MA": "MA", "ANG": "AO", "BOTS": "BW", "DJI": "DJ", "MAUR": "MU", "AUT": "AT", "IRL": "IE",
    "UKR": "UA", "BELA": "BY", "CRO": "HR", "ROM": "RO", "MCO": "MC", "EST": "EE", "LTV": "LV", "PNG": "PG", "SOL": "SB", "ESRO": "EU", "EUTL": "FR",
    "NICO": "INT", "RASC": "INT", "IRID": "US", "STCT": "SG", "GHA": "INT", "USBZ": "US", "FRIT": "FR", "CHBZ": "CN", "SEAL": "US", "NATO": "INT",
    "ISS": "US", "ASRA": "AT", "PRES": "CN", "FGER": "FR",
}
#: State code of the general catalogue -> country.
STATE_COUNTRY = {
    "UK": "GB", "J": "JP", "F": "FR", "I": "IT", "D": "DE", "E": "ES", "L": "LU", "N": "NO", "B": "BE", "T": "TH", "S": "SE", "P": "PT", "UAE": "AE",
    "BGN": "BG", "SU": "RU", "ESIB": "ES", "BM": "GB", "I-EU": "EU", "I-ESA": "EU", "I-EUM": "EU", "I-ELDO": "EU", "I-ESRO": "EU",
}
#: Further names of search entries, by kind and key.
ALIASES = {
    "constellation:starlink": ["spacex", "스타링크"],
    "constellation:kuiper": ["amazon leo", "project kuiper", "카이퍼", "아마존"],
    "constellation:oneweb": ["eutelsat", "원웹"],
    "constellation:gps": ["navstar", "gps", "지피에스"],
    "constellation:galileo": ["갈릴레오"],
    "constellation:beidou": ["compass", "베이더우", "북두"],
    "constellation:glonass": ["글로나스"],
    "constellation:qianfan": ["thousand sails", "g60", "spacesail", "첸판"],
    "constellation:guowang": ["satnet", "hulianwang", "궈왕"],
    "constellation:stations": ["iss", "tiangong", "css", "space station", "우주정거장", "국제우주정거장", "톈궁"],
    "country:KR": ["korea", "south korea", "rok", "한국", "대한민국", "남한"],
    "country:KP": ["north korea", "dprk", "북한"],
    "country:JP": ["japan", "일본"],
    "country:IN": ["india", "인도"],
    "country:GB": ["uk", "britain", "england", "영국"],
    "country:FR": ["프랑스"],
    "country:DE": ["독일"],
    "bloc:US": ["usa", "america", "united states", "미국"],
    "bloc:CN": ["china", "prc", "중국"],
    "bloc:RU": ["russia", "러시아"],
    "bloc:EU": ["europe", "esa", "eu", "유럽"],
    "mission:military": ["defense", "defence", "spy", "reconnaissance", "군사", "정찰"],
    "mission:comms": ["communication", "internet", "broadband", "telecom", "통신"],
    "mission:eo": ["earth observation", "imaging", "weather", "radar", "sar", "관측", "지구관측", "기상"],
    "mission:nav": ["navigation", "gnss", "positioning", "항법", "위성항법"],
    "mission:science": ["telescope", "astronomy", "과학"],
    "mission:human": ["crew", "astronaut", "manned", "유인"],
    "regime:GEO": ["geostationary", "geosynchronous", "정지궤도"],
    "regime:LEO": ["low earth orbit", "저궤도"],
    "regime:MEO": ["medium earth orbit", "중궤도"],
}
#: Nicknames of satellites -> catalogue number.
NICKNAMES = {
    "iss": 25544,
    "international space station": 25544,
    "국제우주정거장": 25544,
    "zarya": 25544,
    "tiangong": 48274,
    "css": 48274,
    "chinese space station": 48274,
    "톈궁": 48274,
    "톈궁 우주정거장": 48274,
    "hubble": 20580,
    "hst": 20580,
    "허블": 20580,
}
#: Mission of a category of the general catalogue (its part before a slash); any other is "tech".
CATEGORY_MISSION = {
    "COM": "comms", "NAV": "nav", "IMG": "eo", "IMG-R": "eo", "EOSCI": "eo", "MET": "eo", "MET-RO": "eo", "GEOD": "eo", "SIG": "military", "EW": "military",
    "WEAPON": "military", "TARG": "military", "SS": "human", "SCI": "science", "AST": "science", "MGRAV": "science", "BIO": "science", "PLAN": "science", "SOLAR": "science",
}
#: Sector by the first letter of a class.
CLASS_SECTOR = {"B": "commercial", "C": "civil", "D": "military", "A": "academic"}
