"""Vocabulary tables.

Every table here is a fixed value: results only agree with earlier runs of the
same farm corpus when the lists, their spelling and their order stay as they are.
"""

from __future__ import annotations

# --- fixed values: closed string sets -------------------------------------------------

LANGUAGES = ["en", "mr", "hi", "mixed", "unknown"]
SPLITS = ["train", "val", "test", "holdout", "unassigned"]
CATEGORIES = [
    "soil", "weather", "crop", "disease", "pest", "fertilizer", "irrigation",
    "scheme", "market", "finance", "machinery", "seed", "advisory", "general",
]
LAKE_DOMAINS = [
    "crop", "disease", "pest", "soil", "fertilizer", "government", "market",
    "irrigation", "seed", "weather", "general", "finance", "machinery", "images",
]
SCHEMA_VERSION = "1.0"
RECORD_LICENSE = "educational-open-compilation"

# --- fixed values: function words used to separate Hindi from Marathi -------------------

HINDI_WORDS = [
    "है", "हैं", "क्या", "की", "के", "का", "में", "और", "नहीं", "यह", "वह",
    "लिए", "से", "पर", "भी", "एक", "को", "था", "थे", "हो", "कर", "गया",
]
MARATHI_WORDS = [
    "आहे", "आहेत", "काय", "ची", "चे", "चा", "मध्ये", "आणि", "नाही", "हे", "ते",
    "साठी", "पासून", "वर", "एक", "ला", "होते", "कर", "गेला", "पाहिजे", "शेतकरी",
]

# --- fixed values: crops (id, English, Marathi, Hindi, group, scientific name) ----------

CROPS = [
    ("cotton", "Cotton", "कापूस", "कपास", "fiber", "Gossypium hirsutum"),
    ("soybean", "Soybean", "सोयाबीन", "सोयाबीन", "oilseed", "Glycine max"),
    ("sugarcane", "Sugarcane", "ऊस", "गन्ना", "cash", "Saccharum officinarum"),
    ("pomegranate", "Pomegranate", "डाळिंब", "अनार", "fruit", "Punica granatum"),
    ("onion", "Onion", "कांदा", "प्याज", "vegetable", "Allium cepa"),
    ("rice", "Rice", "भात", "चावल", "cereal", "Oryza sativa"),
    ("wheat", "Wheat", "गहू", "गेहूं", "cereal", "Triticum aestivum"),
    ("maize", "Maize", "मका", "मक्का", "cereal", "Zea mays"),
    ("tur", "Tur (Pigeon Pea)", "तूर", "अरहर", "pulse", "Cajanus cajan"),
    ("gram", "Gram (Chickpea)", "हरभरा", "चना", "pulse", "Cicer arietinum"),
    ("groundnut", "Groundnut", "भुईमूग", "मूंगफली", "oilseed", "Arachis hypogaea"),
    ("turmeric", "Turmeric", "हळद", "हल्दी", "spice", "Curcuma longa"),
    ("grapes", "Grapes", "द्राक्ष", "अंगूर", "fruit", "Vitis vinifera"),
    ("banana", "Banana", "केळी", "केला", "fruit", "Musa spp."),
    ("mango", "Mango", "आंबा", "आम", "fruit", "Mangifera indica"),
    ("tomato", "Tomato", "टोमॅटो", "टमाटर", "vegetable", "Solanum lycopersicum"),
    ("chilli", "Chilli", "मिरची", "मिर्च", "spice", "Capsicum annuum"),
    ("sorghum", "Sorghum (Jowar)", "ज्वारी", "ज्वार", "cereal", "Sorghum bicolor"),
    ("bajra", "Bajra (Pearl Millet)", "बाजरी", "बाजरा", "cereal", "Pennisetum glaucum"),
    ("mustard", "Mustard", "मोहरी", "सरसों", "oilseed", "Brassica juncea"),
    ("potato", "Potato", "बटाटा", "आलू", "vegetable", "Solanum tuberosum"),
    ("orange", "Orange (Nagpur Santra)", "संत्रा", "संतरा", "fruit", "Citrus reticulata"),
]

# --- fixed values: crop stages (id, English, Marathi, Hindi) ---------------------------

CROP_STAGES = [
    ("seed_selection", "Seed Selection", "बियाणे निवड", "बीज चयन"),
    ("seed_treatment", "Seed Treatment", "बीजप्रक्रिया", "बीज उपचार"),
    ("land_preparation", "Land Preparation", "जमीन तयारी", "भूमि तैयारी"),
    ("sowing", "Sowing", "पेरणी", "बुवाई"),
    ("germination", "Germination", "उगवण", "अंकुरण"),
    ("vegetative", "Vegetative Growth", "वाढीची अवस्था", "वनस्पति वृद्धि"),
    ("flowering", "Flowering", "फुलोरा", "फूलन"),
    ("fruiting", "Fruiting / Boll / Pod", "फळधारणा", "फलन"),
    ("harvest", "Harvest", "कापणी", "कटाई"),
    ("storage", "Storage", "साठवण", "भंडारण"),
]

# --- fixed values: crop aliases, English name -> spellings ------------------------------

CROP_ALIASES = {
    "Cotton": ["cotton", "kapas", "kapus", "कापूस", "कपास", "कपासू", "gossypium"],
    "Soybean": ["soybean", "soya", "soy", "सोयाबीन", "सोया", "glycine max"],
    "Sugarcane": ["sugarcane", "cane", "ऊस", "गन्ना", "oos", "us", "saccharum"],
    "Pomegranate": ["pomegranate", "anar", "dalimb", "डाळिंब", "अनार", "punica"],
    "Onion": ["onion", "kanda", "कांदा", "प्याज", "pyaz", "allium cepa"],
    "Rice": ["rice", "paddy", "dhan", "भात", "तांदूळ", "चावल", "धान", "oryza"],
    "Wheat": ["wheat", "gahu", "gehun", "गहू", "गेहूं", "गेहू", "triticum"],
    "Maize": ["maize", "corn", "maka", "makka", "मका", "मक्का", "zea mays"],
    "Tur (Pigeon Pea)": [
        "tur", "toor", "arhar", "pigeon pea", "red gram", "तूर", "अरहर", "तूर डाळ", "cajanus",
    ],
    "Gram (Chickpea)": ["gram", "chickpea", "chana", "harbhara", "हरभरा", "चना", "cicer"],
    "Groundnut": ["groundnut", "peanut", "mungfali", "bhuimug", "भुईमूग", "मूंगफली", "arachis"],
    "Turmeric": ["turmeric", "halad", "haldi", "हळद", "हल्दी", "curcuma"],
    "Grapes": ["grape", "grapes", "draksh", "द्राक्ष", "अंगूर", "vitis"],
    "Banana": ["banana", "keli", "केळी", "केला", "musa"],
    "Mango": ["mango", "amba", "आंबा", "आम", "mangifera"],
    "Tomato": ["tomato", "tamatar", "टोमॅटो", "टमाटर", "solanum lycopersicum"],
    "Chilli": ["chilli", "chili", "pepper", "mirchi", "मिरची", "मिर्च", "capsicum"],
    "Sorghum (Jowar)": ["sorghum", "jowar", "jwari", "ज्वारी", "ज्वार", "sorghum bicolor"],
    "Bajra (Pearl Millet)": ["bajra", "bajri", "pearl millet", "बाजरी", "बाजरा", "pennisetum"],
    "Mustard": ["mustard", "sarson", "mohri", "मोहरी", "सरसों", "brassica"],
    "Potato": ["potato", "batata", "aloo", "बटाटा", "आलू", "solanum tuberosum"],
    "Orange (Nagpur Santra)": [
        "orange", "santra", "citrus", "nagpur santra", "संत्रा", "नारंगी", "नागपूर संत्रा",
    ],
}

# --- fixed values: category keywords ----------------------------------------------------

CATEGORY_KEYWORDS = {
    "soil": ["soil", "माती", "मिट्टी", "ph", "npk", "soil health", "माती आरोग्य"],
    "weather": [
        "weather", "rain", "rainfall", "monsoon", "humidity", "हवामान", "पाऊस", "मौसम", "temperature",
    ],
    "crop": ["crop", "पीक", "फसल", "sowing", "harvest", "variety", "जात"],
    "disease": ["disease", "blight", "virus", "fungal", "रोग", "व्याधि", "infection", "spot"],
    "pest": ["pest", "insect", "worm", "thrips", "bollworm", "कीड", "कीड़ा", "अळी"],
    "fertilizer": [
        "fertilizer", "manure", "urea", "dap", "mop", "npk", "nutrient",
        "खत", "उर्वरक", "यूरिया", "युरिया", "डीएपी", "पालाश", "नत्र", "स्फुरद",
    ],
    "irrigation": ["irrigation", "drip", "sprinkler", "सिंचन", "ठिबक", "सिंचाई", "water"],
    "scheme": ["scheme", "subsidy", "yojana", "pm-kisan", "pmfby", "योजना", "अनुदान", "सब्सिडी"],
    "market": ["market", "mandi", "price", "msp", "भाव", "बाजार", "मंडी", "दर"],
    "finance": ["loan", "kcc", "credit", "insurance", "roi", "कर्ज", "वित्त", "बीमा"],
    "machinery": ["tractor", "drone", "sprayer", "harvester", "यंत्र", "ट्रॅक्टर", "ट्रैक्टर"],
    "seed": ["seed", "hybrid", "variety", "बियाणे", "बीज"],
    "advisory": ["advisory", "recommendation", "salla", "सल्ला", "सलाह"],
}

# Planner intents, each the union of one or two keyword categories.
INTENT_SOURCES = {
    "weather": ["weather"],
    "disease": ["disease", "pest"],
    "market": ["market"],
    "fertilizer": ["fertilizer", "soil"],
    "scheme": ["scheme"],
    "irrigation": ["irrigation"],
    "seed": ["seed"],
    "finance": ["finance"],
    "machinery": ["machinery"],
}
WEB_TRIGGERS = [
    "latest", "today", "current", "news", "2024", "2025", "2026", "web", "online",
    "update", "recent", "forecast", "live", "आता", "आज", "ताजे", "सद्य",
]
INTENT_EXPANSIONS = {
    "disease": "{crop} pest disease IPM organic chemical control ICAR",
    "fertilizer": "{crop} fertilizer NPK recommendation kg per acre soil",
    "market": "{crop} mandi price Maharashtra Agmarknet modal rate",
    "scheme": "{crop} government scheme subsidy insurance Maharashtra PMFBY",
    "irrigation": "{crop} drip irrigation water requirement schedule",
    "weather": "{crop} weather advisory humidity rainfall pest risk",
    "seed": "{crop} recommended seed varieties India ICAR",
    "machinery": "{crop} farm machinery sprayer seeder recommendation",
}

# --- fixed values: list key / lake domain -> category -----------------------------------

LIST_KEY_CATEGORY = {
    "diseases_and_pests": "disease",
    "diseases": "disease",
    "schemes": "scheme",
    "advisories": "advisory",
    "markets": "market",
    "varieties": "seed",
    "practices": "irrigation",
    "zones": "weather",
    "soil_types": "soil",
    "fertilizer_recommendations": "fertilizer",
    "crops": "crop",
}
DOMAIN_CATEGORY = {
    "crop": "crop",
    "disease": "disease",
    "pest": "pest",
    "soil": "soil",
    "fertilizer": "fertilizer",
    "government": "scheme",
    "market": "market",
    "irrigation": "irrigation",
    "seed": "seed",
    "weather": "weather",
    "finance": "finance",
    "machinery": "machinery",
    "general": "general",
}
RECORD_LIST_KEYS = [
    "crops", "diseases_and_pests", "markets", "schemes", "advisories", "varieties",
    "practices", "zones", "soil_types", "fertilizer_recommendations", "sources",
    "nodes", "edges", "records",
]
DOMAIN_KEY_HINTS = {
    "crop": ["crops", "advisories", "varieties"],
    "disease": ["diseases_and_pests", "diseases", "crops"],
    "pest": ["diseases_and_pests", "pests", "crops"],
    "soil": ["soil_types", "fertilizer_recommendations"],
    "fertilizer": ["fertilizer_recommendations", "soil_types"],
    "government": ["schemes"],
    "market": ["markets", "records"],
    "irrigation": ["practices"],
    "seed": ["varieties"],
    "weather": ["zones", "records"],
    "general": ["nodes", "edges", "advisories", "sources", "meta"],
    "finance": ["schemes", "records"],
    "machinery": ["records", "items"],
    "images": [],
}
NODE_LABEL_CATEGORY = {
    "crop": "crop", "pest": "pest", "disease": "disease", "soil": "soil",
    "fertilizer": "fertilizer", "scheme": "scheme", "weathercondition": "weather",
    "weather": "weather",
}

# --- fixed values: regions (state id, state, zone, districts) ---------------------------

ZONES = [
    ("MH", "Maharashtra", "Western Maharashtra Scarcity", ["Solapur", "Ahmednagar", "Pune", "Satara"]),
    ("MH", "Maharashtra", "Marathwada", [
        "Chhatrapati Sambhajinagar", "Aurangabad", "Beed", "Latur", "Nanded", "Parbhani",
        "Hingoli", "Jalna", "Dharashiv", "Osmanabad",
    ]),
    ("MH", "Maharashtra", "Vidarbha", [
        "Nagpur", "Amravati", "Akola", "Yavatmal", "Wardha", "Buldhana", "Washim",
        "Chandrapur", "Gadchiroli", "Gondia", "Bhandara",
    ]),
    ("MH", "Maharashtra", "Konkan", ["Thane", "Raigad", "Ratnagiri", "Sindhudurg", "Palghar", "Mumbai"]),
    ("MH", "Maharashtra", "Western Ghat / Transition", ["Kolhapur", "Sangli", "Satara", "Nashik"]),
    ("MH", "Maharashtra", "Khandesh / North MH", ["Jalgaon", "Dhule", "Nandurbar"]),
    ("MP", "Madhya Pradesh", "Malwa / Central India plains", ["Indore", "Ujjain", "Bhopal"]),
    ("KA", "Karnataka", "North Karnataka", ["Belagavi", "Kalaburagi"]),
    ("GJ", "Gujarat", "Saurashtra", ["Rajkot", "Junagadh"]),
]
DISTRICT_ALIASES = [
    ("pune", "MH", "Pune"), ("पुणे", "MH", "Pune"),
    ("solapur", "MH", "Solapur"), ("सोलापूर", "MH", "Solapur"),
    ("latur", "MH", "Latur"), ("लातूर", "MH", "Latur"),
    ("akola", "MH", "Akola"), ("अकोला", "MH", "Akola"),
    ("nagpur", "MH", "Nagpur"), ("नागपूर", "MH", "Nagpur"),
    ("nashik", "MH", "Nashik"), ("नाशिक", "MH", "Nashik"), ("nasik", "MH", "Nashik"),
    ("kolhapur", "MH", "Kolhapur"), ("कोल्हापूर", "MH", "Kolhapur"),
    ("sangli", "MH", "Sangli"), ("सांगली", "MH", "Sangli"),
    ("jalgaon", "MH", "Jalgaon"), ("जळगाव", "MH", "Jalgaon"),
    ("aurangabad", "MH", "Chhatrapati Sambhajinagar"),
    ("chhatrapati sambhajinagar", "MH", "Chhatrapati Sambhajinagar"),
    ("sambhajinagar", "MH", "Chhatrapati Sambhajinagar"),
    ("beed", "MH", "Beed"), ("बीड", "MH", "Beed"),
    ("nanded", "MH", "Nanded"), ("नांदेड", "MH", "Nanded"),
    ("yavatmal", "MH", "Yavatmal"), ("यवतमाळ", "MH", "Yavatmal"),
    ("wardha", "MH", "Wardha"), ("वर्धा", "MH", "Wardha"),
    ("mumbai", "MH", "Mumbai"), ("मुंबई", "MH", "Mumbai"),
    ("ahmednagar", "MH", "Ahmednagar"), ("अहमदनगर", "MH", "Ahmednagar"),
    ("ahilyanagar", "MH", "Ahmednagar"),
    ("dhule", "MH", "Dhule"), ("धुळे", "MH", "Dhule"),
    ("parbhani", "MH", "Parbhani"), ("परभणी", "MH", "Parbhani"),
    ("indore", "MP", "Indore"), ("इंदौर", "MP", "Indore"),
]

# --- fixed values: units; a number converts to the canonical unit, a string names it ----

UNITS = {
    "mass": ("kg", {
        "kg": 1.0, "kilogram": 1.0, "किलो": 1.0, "g": 0.001, "gram": 0.001,
        "quintal": 100.0, "q": 100.0, "क्विंटल": 100.0, "tonne": 1000.0, "t": 1000.0,
        "टन": 1000.0, "lb": 0.453592,
    }),
    "area": ("ha", {
        "ha": 1.0, "hectare": 1.0, "हेक्टर": 1.0, "acre": 0.404686, "ac": 0.404686,
        "एकर": 0.404686, "guntha": 0.010117, "गुंठा": 0.010117,
    }),
    "rate_mass_per_area": ("kg/ha", {
        "kg/ha": 1.0, "kg per ha": 1.0, "kg/acre": 2.47105, "किलो/हेक्टर": 1.0, "किलो/एकर": 2.47105,
    }),
    "temperature": ("C", {
        "c": "C", "°c": "C", "celsius": "C", "सेल्सिअस": "C", "f": "F", "°f": "F", "fahrenheit": "F",
    }),
    "rainfall": ("mm", {
        "mm": 1.0, "millimeter": 1.0, "मिमी": 1.0, "cm": 10.0, "inch": 25.4, "इंच": 25.4,
    }),
    "currency": ("INR", {"inr": "INR", "rs": "INR", "₹": "INR", "rupee": "INR", "रुपये": "INR"}),
    "price": ("INR/quintal", {
        "rs/q": "INR/quintal", "₹/q": "INR/quintal", "rs/quintal": "INR/quintal",
        "inr/quintal": "INR/quintal", "रु/क्विंटल": "INR/quintal",
    }),
    "volume_water": ("L", {
        "l": 1.0, "liter": 1.0, "litre": 1.0, "लिटर": 1.0, "ml": 0.001, "m3": 1000.0,
    }),
    "concentration": ("g/L", {
        "g/l": "g/L", "g/L": "g/L", "ml/l": "ml/L", "ppm": "ppm", "ग्रॅम/लिटर": "g/L",
    }),
    "percentage": ("%", {"%": 1.0, "pct": 1.0, "percent": 1.0, "टक्के": 1.0}),
    "ec": ("dS/m", {"ds/m": "dS/m", "mmhos/cm": "dS/m", "ms/cm": "dS/m"}),
    "ph": ("pH", {"ph": "pH", "पीएच": "pH"}),
}

# --- fixed values: other taxonomy dimensions ---------------------------------------------

TAXONOMY_VERSION = "1.0.0"
IRRIGATION_TYPES = ["drip", "flood", "sprinkler", "canal", "rainfed"]
FERTILIZER_TYPES = ["urea", "dap", "mop", "ssp", "fym", "vermicompost", "npk_water_soluble", "gypsum"]
MACHINERY_TYPES = ["tractor", "drone", "sprayer", "seeder", "harvester"]
SCHEME_CATALOG = [
    "pm_kisan", "pmfby", "soil_health_card", "pm_kusum", "pmksy", "pocra", "kcc", "midh", "enam", "nfsm",
]
SOIL_TYPES = ["black_cotton", "medium_black", "red_laterite", "alluvial", "sandy_loam", "clay_loam"]


def crop_alias_rows() -> list[tuple[str, str, int]]:
    """(alias, canonical, ordinal): every spelling plus the canonical name itself.

    A repeated alias keeps its first position but takes the last canonical name, so a
    lookup on this table is unambiguous.
    """
    seen: dict[str, str] = {}
    for name, spellings in CROP_ALIASES.items():
        for alias in [*spellings, name]:
            key = alias.lower().strip()
            if key:
                seen[key] = name
    return [(alias, name, i) for i, (alias, name) in enumerate(seen.items())]


def intent_keywords() -> dict[str, list[str]]:
    """Intent -> keywords, duplicates removed in order."""
    return {
        intent: list(dict.fromkeys(k for c in cats for k in CATEGORY_KEYWORDS[c]))
        for intent, cats in INTENT_SOURCES.items()
    }


def district_names(state_id: str = "MH") -> list[str]:
    """Distinct districts of one state in listing order."""
    return list(dict.fromkeys(d for sid, _, _, ds in ZONES if sid == state_id for d in ds))


def district_rows() -> list[tuple[str, str, str, str, str | None, int]]:
    """(alias, state id, state, district, zone, ordinal) with the first zone listing the district."""
    state_names = {sid: name for sid, name, _, _ in ZONES}
    zone_of: dict[tuple[str, str], str] = {}
    for sid, _, zone, names in ZONES:
        for d in names:
            zone_of.setdefault((sid, d), zone)
    return [
        (alias, sid, state_names[sid], d, zone_of.get((sid, d)), i)
        for i, (alias, sid, d) in enumerate(DISTRICT_ALIASES)
    ]


def unit_rows() -> list[tuple[str, str, float | None, str, int]]:
    """(dimension, alias, factor or null, canonical name, ordinal)."""
    rows = []
    for dim, (canonical, aliases) in UNITS.items():
        for alias, value in aliases.items():
            factor = value if isinstance(value, float) else None
            name = canonical if isinstance(value, float) else value
            rows.append((dim, alias, factor, name, len(rows)))
    return rows
