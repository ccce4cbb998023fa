"""Descriptions put together from phrases of known meaning: every attribute of jackets, gloves, trousers and boots.

The oracle knows which phrases each text has and what each one says, and nothing of how texts are read.
"""

from offerloom.operators import extract
from offerloom.plans.dialect import frame, run_text

_WET = (("étanche", {"waterproof": "yes"}), ("non imperméable", {"waterproof": "no"}), ("", {}))
_AIR = (("aérations zippées", {"ventilation": "yes"}), ("pas de ventilation", {"ventilation": "no"}), ("", {}))
_SEEN = (("inserts réfléchissants", {"reflective": "yes"}), ("", {}))
_SEASONS = (("hiver", {"season": "winter"}), ("été", {"season": "summer"}), ("mi-saison", {"season": "between"}), ("toutes saisons", {"season": "all seasons"}), ("", {}))
_SEXES = (("femme", {"sex": "woman"}), ("homme", {"sex": "man"}), ("enfant", {"sex": "child"}), ("mixte", {"sex": "mixed"}))
_RIDINGS = (("touring", {"riding": "touring"}), ("racing", {"riding": "sport"}), ("enduro", {"riding": "enduro"}), ("biker", {"riding": "custom"}), ("urbain", {"riding": "urban"}))
_MEMBRANES = (("membrane Drystar", {"membrane": "drystar"}), ("Gore-Tex laminé", {"membrane": "gore-tex", "gore-tex": "laminated"}), ("membrane en option", {}), ("sans membrane", {}), ("membrane maison", {"membrane": "other"}))
_CLASSES = (("classe AA", {"approval": "AA"}), ("classe B", {"approval": "B"}), ("certifiée AAA", {"approval": "AAA"}), ("", {}))

#: For each category groups of phrases of which a text has one each, and what they say.
PHRASES = {
    "jacket": (
        (("Veste cuir", {"material": "leather"}), ("Veste textile", {"material": "textile"}), ("Veste mesh", {"material": "mesh"}), ("Veste cuir et textile", {"material": "leather and textile"}), ("Veste denim", {"material": "denim"})),
        (("EN 17092 : AA", {"en 17092": "yes", "approval": "AA"}), ("classe A", {"approval": "A"}), ("", {})),
        (("dorsale fournie", {"back protector": "supplied"}), ("dorsale en option", {"back protector": "prepared"}), ("sans dorsale", {"back protector": "no"}), ("poche dorsale", {"back protector": "supplied", "back pocket": "yes"})),
        (("coques aux coudes", {"elbow protectors": "supplied"}), ("logement coudes", {"elbow protectors": "prepared"}), ("sans coudes", {"elbow protectors": "no"})),
        (("coques aux épaules", {"shoulder protectors": "supplied"}), ("épaules en option", {"shoulder protectors": "prepared"}), ("", {})), _WET, _MEMBRANES,
        (("doublure thermique amovible", {"thermal liner": "yes", "removable liner": "yes"}), ("doublure chaude", {"thermal liner": "yes"}), ("doublure thermique en option", {}), ("pas de doublure thermique", {"thermal liner": "no"})),
        _SEASONS, _RIDINGS, _SEXES, _AIR, _SEEN, (("airbag", {"airbag ready": "yes"}), ("", {})), (("4 poches", {"pockets": "4"}), ("99 poches", {}), ("12 poches", {"pockets": "12"})),
        (("serrage taille", {"adjusters": "yes"}), ("", {})), (("zip de liaison", {"zip to trousers": "yes"}), ("sans zip de raccordement", {"zip to trousers": "no"})),
    ),
    "glove": (
        (("Gants cuir", {"material": "leather"}), ("Gants textile", {"material": "textile"}), ("Gants cuir et textile", {"material": "leather and textile"})), _SEASONS, _WET, (("Gore-Tex", {"gore-tex": "yes"}), ("", {})),
        (("chauffants", {"heated": "yes"}), ("non chauffants", {"heated": "no"}), ("", {})), _RIDINGS, _SEXES, (("EN 13594", {"approval": "EN 13594"}), ("homologués", {"approval": "CE"}), ("", {})),
        (("niveau 1 KP", {"level": "1", "kp": "yes"}), ("niveau 2", {"level": "2"}), ("", {})), (("paume en chèvre", {"palm": "goatskin"}), ("paume en daim", {"palm": "suede"}), ("", {})), (("dos softshell", {"back of hand": "softshell"}), ("", {})),
        (("coques carbone", {"knuckles": "yes", "shell": "carbon"}), ("coque rigide", {"knuckles": "yes", "shell": "rigid"}), ("pas de coques", {"knuckles": "no"})), (("slider", {"palm slider": "yes"}), ("", {})), (("renfort à la paume", {"palm padding": "yes"}), ("", {})),
        (("scaphoïde", {"scaphoid": "yes"}), ("", {})), (("manchette longue", {"cuff": "long"}), ("manchette courte", {"cuff": "short"}), ("manchette mi-longue", {"cuff": "half"})), (("doublure chaude", {"thermal liner": "yes"}), ("", {})), (("tactile", {"touch screen": "yes"}), ("", {})), _AIR,
    ),
    "trousers": (
        (("Pantalon cuir", {"kind": "trousers", "material": "leather"}), ("Jean", {"kind": "jeans", "material": "denim"}), ("Cargo textile", {"kind": "cargo", "material": "textile"}), ("Leggings mesh", {"kind": "leggings", "material": "mesh"})), _RIDINGS, _SEXES,
        (("renforts en kevlar", {"named fabric": "kevlar", "aramid": "yes", "aramid extent": "zones"}), ("cordura", {"named fabric": "cordura", "reinforced fabric": "yes"}), ("aramide intégral", {"aramid": "yes", "aramid extent": "whole"}), ("", {})), _CLASSES,
        (("genoux niveau 2", {"knee protectors": "supplied", "knee level": "2"}), ("emplacement genoux", {"knee protectors": "prepared"}), ("sans genoux", {"knee protectors": "no"})), (("hanches niveau 1", {"hip protectors": "supplied", "hip level": "1"}), ("hanches en option", {"hip protectors": "prepared"}), ("", {})),
        (("genouillères réglables", {"adjustable knees": "yes"}), ("", {})), (("sliders", {"slider room": "yes"}), ("", {})), _WET, tuple((p, {k: v for k, v in says.items() if k == "membrane"}) for p, says in _MEMBRANES), (("doublure thermique amovible", {"thermal liner": "removable"}), ("doublure fixe", {"thermal liner": "fixed"}), ("doublure chaude", {"thermal liner": "there"}), ("", {})),
        _SEASONS, (("slim", {"cut": "slim"}), ("coupe droite", {"cut": "straight"}), ("ample", {"cut": "loose"}), ("", {})), _AIR, (("zip de liaison", {"zip to jacket": "yes"}), ("", {})), _SEEN, (("stretch", {"stretch": "yes"}), ("", {})),
    ),
    "boots": (
        (("Bottes cuir", {"kind": "boots", "material": "leather"}), ("Baskets textile", {"kind": "trainers", "material": "textile"}), ("Demi-bottes microfibre", {"kind": "half boots", "material": "synthetic"})), _RIDINGS, _SEXES, (("montantes", {"height": "high"}), ("basses", {"height": "low"}), ("", {})), _WET,
        (("malléoles", {"ankle protectors": "supplied"}), ("sans chevilles", {"ankle protectors": "no"}), ("", {})), (("tibia", {"shin protectors": "supplied"}), ("", {})), (("sélecteur", {"shift pad": "yes"}), ("", {})),
        (("EN 13634:2017 2 1 2 2", {"approval": "EN 13634", "height index": "2", "abrasion index": "1", "cut index": "2", "rigidity index": "2"}), ("homologuées", {"approval": "CE"}), ("", {})), _MEMBRANES, (("bout de pied", {}), ("renfort de bout de pied", {"toe cap": "yes"})),
        (("lacets et zip", {"closing": "laces and zip"}), ("boucles", {"closing": "buckles"}), ("velcro", {"closing": "velcro"}), ("", {})), (("semelle Vibram", {"sole": "vibram"}), ("", {})), (("antidérapante", {"anti slip sole": "yes"}), ("", {})), (("anti-huile", {"oil resistant sole": "yes"}), ("", {})), _AIR, _SEEN,
    ),
}


def _choice(g: int, n: int, div: str) -> str:
    """Which phrase of a group a text has."""
    return f"(p_partkey * {g + 2} + {div.format(a='p_partkey', b=g + 3)}) % {n}"


def _named(name: str, category: str) -> None:
    groups = PHRASES[category]

    def oracle(_):
        said = [f"SELECT p_partkey AS id, x.name, x.value FROM part JOIN (VALUES {', '.join(rows)}) AS x(k, name, value) ON x.k = {_choice(g, len(group), '{a} // {b}')}" for g, group in enumerate(groups) if (rows := [f"({k}, '{a}', '{v}')" for k, (_, says) in enumerate(group) for a, v in says.items()])]
        return " UNION ALL ".join(said)

    def read(spark, sf_dir):
        phrases = [f"CASE {_choice(g, len(group), '{a} DIV {b}')} {' '.join(f"WHEN {k} THEN '{phrase}'" for k, (phrase, _) in enumerate(group) if phrase)} END" for g, group in enumerate(groups)]
        return extract.attributes(run_text(spark, sf_dir, f"SELECT p_partkey AS id, concat_ws('. ', {', '.join(phrases)}) AS body FROM part"), "id", "body", category)

    frame(name, oracle)(read)


_named("x10_jacket_names", "jacket")
_named("x11_glove_names", "glove")
_named("x12_trouser_names", "trousers")
_named("x13_boot_names", "boots")
