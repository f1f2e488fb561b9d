"""Controlled vocabularies. Every list below is a fixed value: order is priority order."""

from __future__ import annotations

# Material families.
MATERIALS = {
    "fabric": [
        "fabric", "cloth", "textile", "cotton", "bomull", "linen", "linne", "polyester", "tyg", "klädsel", "remix",
        "hallingdal", "steelcut", "canvas", "tweed", "chenille",
    ],
    "leather": ["leather", "läder", "skinn", "nubuck", "nappa"],
    "velvet": ["velvet", "sammet", "velour"],
    "boucle": ["boucle", "bouclé"],
    "wool": ["wool", "ull", "ylle", "merino", "felt", "filt"],
    "wood": [
        "wood", "timber", "oak", "ek", "birch", "björk", "pine", "furu", "teak", "walnut", "valnöt", "ash", "ask",
        "beech", "bok", "bamboo", "bambu",
    ],
    "metal": [
        "metal", "metall", "steel", "stål", "iron", "järn", "chrome", "krom", "aluminium", "aluminum", "brass",
        "mässing", "copper", "koppar",
    ],
    "rattan": ["rattan", "rotting", "wicker", "korg"],
    "plastic": ["plastic", "plast", "polypropylene", "polypropen", "acrylic", "akryl", "abs"],
    "mixed": ["mixed", "combination", "kombination"],
}

# Colour families.
COLORS = {
    "white": ["white", "vit", "bianco", "ivory", "elfenben", "snow", "chalk", "krita"],
    "beige": [
        "beige", "sand", "cream", "off-white", "natural", "linen", "linne", "taupe", "ecru", "oat", "wheat",
        "havremjölk",
    ],
    "brown": [
        "brown", "brun", "marron", "walnut", "oak", "cognac", "camel", "tan", "chocolate", "espresso", "mocha",
        "terracotta", "terrakotta", "rust", "rost", "copper", "koppar",
    ],
    "gray": [
        "gray", "grey", "grå", "anthracite", "antracit", "charcoal", "kol", "graphite", "grafit", "silver", "ash",
        "aska", "slate", "stone", "cement",
    ],
    "black": ["black", "svart", "noir", "jet", "onyx", "ebony"],
    "green": [
        "green", "grön", "vert", "olive", "oliv", "sage", "salvia", "moss", "mossa", "forest", "emerald", "khaki",
        "mint",
    ],
    "blue": [
        "blue", "blå", "bleu", "navy", "marinblå", "marin", "indigo", "cobalt", "teal", "petrol", "ocean", "sky",
        "denim",
    ],
    "red": ["red", "röd", "rouge", "burgundy", "vinröd", "bordeaux", "crimson", "wine", "vin", "cherry", "maroon"],
    "yellow": [
        "yellow", "gul", "jaune", "mustard", "senap", "gold", "guld", "honey", "honung", "amber", "bärnsten",
        "curry",
    ],
    "orange": ["orange", "terracotta", "terrakotta", "peach", "persika", "apricot", "coral", "korall"],
    "pink": ["pink", "rosa", "blush", "dusty rose", "salmon", "lax", "fuchsia", "magenta"],
    "multi": ["multi", "multicolor", "mixed", "flerfärgad", "mönstrad", "patterned"],
}

# Product types from breadcrumbs and title.
PRODUCT_TYPES = {
    "sofa": ["soffa", "soffor", "sofa", "sofas", "couch"],
    "armchair": ["fåtölj", "fåtöljer", "armchair", "armchairs", "karmstol"],
    "bed_sofa": ["bäddsoffa", "bäddsoffor", "sleeper", "sofa bed"],
    "corner_sofa": ["hörnsoffa", "hörnsoffor", "corner sofa", "divansoffa"],
    "dining_table": ["matbord", "dining table"],
    "coffee_table": ["soffbord", "coffee table"],
    "bookshelf": ["bokhylla", "bookshelf", "bookcase"],
    "desk": ["skrivbord", "desk"],
    "bed": ["säng", "sängar", "bed", "beds"],
    "rug": ["matta", "mattor", "rug", "rugs"],
    "lamp": ["lampa", "lampor", "lamp", "light", "lighting"],
    "chair": ["stol", "stolar", "chair", "chairs"],
    "storage": ["förvaring", "storage", "byrå", "dresser", "sideboard"],
    "outdoor": ["utomhus", "outdoor", "trädgård", "garden"],
}

# Derived style and eco tags.
STYLES = {
    "modern": ["modern", "samtida", "contemporary"],
    "scandinavian": ["scandinavian", "nordic", "nordisk", "skandinavisk"],
    "minimal": ["minimal", "minimalist", "avskalad"],
    "industrial": ["industrial", "industriell", "loft"],
    "bohemian": ["boho", "bohemian", "bohemisk"],
    "rustic": ["rustic", "lantlig", "country"],
    "classic": ["classic", "klassisk", "traditional"],
    "coastal": ["coastal", "marin", "beach", "strand"],
}
ECO = {
    "fsc": ["fsc", "fsc-certifierad", "fsc certified"],
    "recycled": ["recycled", "återvunnen", "återvunnet", "återvun"],
    "organic": ["organic", "ekologisk", "eko"],
    "low_impact": ["svanen", "miljömärkt", "climate", "co2", "hållbar"],
}

# Keyword lists of the item flags.
FLAGS = {
    "modular": ["modular", "modul", "sectional", "modulsoffa", "sektionssoffa", "byggbar"],
    "small_space": ["compact", "kompakt", "small space", "liten", "2-sits", "2 sits", "loveseat"],
    "delivery_high": [
        "requires assembly", "montering krävs", "2-man", "tvåmannaleverans", "bulky", "heavy", "specialfrakt",
    ],
    "delivery_low": ["flatpack", "self assembly", "lätt", "easy delivery", "click and collect"],
    "size_large": [
        "u-soffa", "u-formad", "modulsoffa", "hörnbäddsoffa", "hörnsoffa", "u-bäddsoffa", "sectional", "corner sofa",
        "modular",
    ],
    "size_small": ["fåtölj", "armchair", "schäslong", "chaise", "fotpall", "ottoman", "puff", "loveseat"],
}
