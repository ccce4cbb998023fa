"""Attributes out of free descriptions: rule tables evaluated as SQL expressions, and the merge of several readings.

A description is cut into clauses at strong punctuation. A rule reads one attribute: a flag (pattern present), a word out
of a vocabulary, what an article is fitted with, or a number with bounds. What a clause denies (a negation up to two
words before the match) is no reading, but a flag's denial is "no"; what a clause only reserves (optional, sold apart,
room for) is no reading either, but for things to fit: these are "prepared" then, and a text that says both is read as
prepared. Rules of a category are a table, so a new attribute is a row, and all of them are evaluated in one pass over
the text inside the JVM. Texts of accessories (SKIPPED) give no reading.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_NOT = r"(?:sans|pas de|non|aucune?|without|no|not)\s+(?:\p{L}+\s+){0,2}"
#: Ends of clauses; a point inside a number is none.
_CLAUSE = r"[;:!?•\n]|[.](?=\s|$)"
#: A clause with one of these says that something can be had, not that it is there.
_RESERVED = r"en option|optionnel|vendu(?:e|s|es)? s[eé]par[eé]ment|non (?:inclus|fourni)|pr[eé]disposition|pr[eé]vue? pour|poches? pour|emplacement|logement|compatible|pr[eê]te? [aà] recevoir|sold separately|optional|not included|ready for|prepared for|pocket for"


#: Named things that one can also buy for an article; other words (materials, seasons) a reserve in their clause leaves alone.
_SOLD_APART = ("membrane", "gore-tex", "thermal liner", "intercom")


@dataclass(frozen=True)
class Rule:
    name: str
    pattern: str  # for a number, with one group
    value: str = ""  # of a word; empty: a flag, or a number if least is given
    least: int | None = None
    most: int | None = None
    fitted: bool = False  # a thing that is supplied, or that the article is prepared for

    def reading(self, low: Column, clauses: Column) -> Column:
        """The attribute's value in a lower-case text and its clauses; null where they do not say."""
        if self.least is not None:
            number = F.regexp_extract(low, self.pattern, 1)
            return F.when(F.when(number != "", number.cast("int")).between(self.least, self.most), number.cast("int").cast("string"))

        def affirmed(clause: Column) -> Column:
            return F.regexp_replace(clause, _NOT + f"(?:{self.pattern})", " ").rlike(self.pattern)

        there = F.exists(clauses, lambda c: affirmed(c) & ~c.rlike(_RESERVED))
        denied = low.rlike(_NOT + f"(?:{self.pattern})")
        if self.fitted:
            reserved = F.exists(clauses, lambda c: affirmed(c) & c.rlike(_RESERVED))
            return F.when(reserved, F.lit("prepared")).when(there, F.lit("supplied")).when(denied, F.lit("no"))
        if self.value:
            return F.when(there if self.name in _SOLD_APART else F.exists(clauses, affirmed), F.lit(self.value))
        return F.when(there, F.lit("yes")).when(denied, F.lit("no"))


def words(name: str, **patterns: str) -> tuple[Rule, ...]:
    """A vocabulary of one attribute, tried in order; in the names of its values, _ stands for a space."""
    return tuple(Rule(name, rf"\b(?:{p})\b", value.strip("_").replace("_", " ")) for value, p in patterns.items())


def flags(**patterns: str) -> tuple[Rule, ...]:
    return tuple(Rule(name.replace("_", " "), rf"\b(?:{p})\b") for name, p in patterns.items())


def fittings(**patterns: str) -> tuple[Rule, ...]:
    return tuple(Rule(name.replace("_", " "), rf"\b(?:{p})\b", fitted=True) for name, p in patterns.items())


_WET, _THERMAL, _AIR, _SEEN = r"imperm[eé]able|waterproof|[eé]tanche", r"doublure (?:thermique|chaude)|thermal lin(?:er|ing)", r"ventilations?|a[eé]rations?|vents?|a[eé]r[eé]e?", r"r[eé]fl[eé]chissante?s?|reflective"
_MEMBRANES = {"gore-tex": r"gore[- ]?tex", "drystar": "drystar", "hydratex": "hydratex", "d-dry": r"d[- ]dry", "other": "membrane"}
_RIDING = words("riding", cross="cross", enduro="enduro", trail="trail|adventure", touring="touring|gt|voyage", sport="sport|racing", custom="custom|biker|vintage", roadster="roadster", urban="urbain|city|scooter")
_SEX = words("sex", woman="femme|lady|ladies|women", child="enfant|junior|kids", man="homme|men", mixed="mixte|unisexe?")
_SEASON = words("season", all_seasons="toutes saisons|4 saisons|all seasons", between="mi[- ]saison", winter="hiver|winter", summer=r"[eé]t[eé]|summer")
_GORE = words("gore-tex", laminated=r"gore[- ]?tex (?:pro )?lamin[eé]e?", yes=r"gore[- ]?tex")
_MEMBRANE = tuple(Rule("membrane", rf"\b(?:{p})\b", v) for v, p in _MEMBRANES.items())
_CLASSES = tuple(Rule("approval", rf"\b(?:en ?17092[^.;]{{0,20}}|classe |class |certifi[eé]e? (?:ce )?){c}\b|\b{c}\b" if len(c) > 1 else rf"\b(?:en ?17092[-: ]{{1,3}}(?:[1-5][: ]{{1,3}})?(?:20[0-9]{{2}}[: ]{{1,3}})?|classe |class ){c}\b", c.upper()) for c in ("aaa", "aa", "a", "b", "c"))


#: Rule tables by category; words of the same attribute are tried in order.
CATEGORIES: dict[str, tuple[Rule, ...]] = {
    "helmet": (
        Rule("standard", r"\b(?:ece )?(?:22[.-]?06)\b", "22.06"), Rule("standard", r"\b(?:ece )?(?:22[.-]?05)\b", "22.05"),
        *words("shell", carbon="carbone?", fibre="fibres?", polycarbonate="polycarbonate", thermoplastic="thermoplastique|abs"),
        *words("buckle", double_D=r"double[- ]d", micrometric=r"microm[eé]trique"),
        Rule("weight", r"\b([0-9]{3,4}) ?g(?:r|rammes)?\b", least=900, most=2000), *fittings(insert="pinlock", intercom="intercom|bluetooth"),
        *flags(sun_visor=r"(?:[eé]cran|visi[eè]re) solaire|sun visor"), Rule("vents", r"\b([0-9]{1,2}) (?:a[eé]rations|ventilations|vents)\b", least=1, most=20), *flags(liner=r"d[eé]houssable|removable|washable|int[eé]rieur amovible"),
    ),
    "jacket": (
        *words("material", leather_and_textile="cuir et textile|cuir[- ]textile", leather="cuir|leather", textile="textile", mesh="mesh", denim="denim"), *flags(en_17092=r"en ?17092"), *_CLASSES,
        *fittings(back_protector="protection dorsale|dorsale|back protector", shoulder_protectors=r"[eé]paules?|shoulders?", elbow_protectors="coudes?|elbows?"), *flags(back_pocket="poches? (?:pour )?(?:protection )?dorsale|back protector pocket", waterproof=_WET), *_MEMBRANE, *_GORE,
        *flags(thermal_liner=_THERMAL, removable_liner=r"doublure (?:thermique )?amovible|removable (?:thermal )?lin(?:er|ing)", airbag_ready="airbag"), Rule("pockets", r"\b([0-9]{1,2}) poches\b", least=1, most=20), *_SEASON, *_RIDING, *_SEX,
        *flags(ventilation=_AIR, adjusters=r"serrages?|r[eé]glages?|sangles?|adjust(?:ers?|able)", zip_to_trousers=r"zip de (?:liaison|raccordement)|connection zip", reflective=_SEEN),
    ),
    "glove": (
        *words("material", leather_and_textile="cuir et textile|cuir[- ]textile", leather="cuir|leather", textile="textile"), *_SEASON, *flags(waterproof=_WET), *_GORE, *flags(heated="chauffante?s?|heated"), *_RIDING, *_SEX,
        *words("approval", EN_13594=r"en ?13594", CE=r"ce|homologu[eé]e?s?"), *words("level", _1="1 ?kp|niveau 1|level 1", _2="2 ?kp|niveau 2|level 2"), *flags(kp="[12]? ?kp"),
        *words("palm", goatskin=r"paume (?:en )?(?:cuir de )?ch[eè]vre", leather="paume (?:en )?cuir", suede="paume (?:en )?(?:daim|su[eè]de)", textile="paume (?:en )?textile"), *words("back of hand", leather="dos (?:de la main )?(?:en )?cuir", softshell="dos (?:en )?softshell", textile="dos (?:en )?textile"),
        *flags(knuckles="coques?|phalanges|knuckles?"), *words("shell", carbon="coques? (?:en )?carbone", TPU="coques? (?:en )?tpu", rigid="coques? rigides?"), *flags(palm_slider="sliders?", palm_padding=r"renforts? (?:[aà] la |de )?paume|palm reinforcement", scaphoid=r"scapho[iï]de"),
        *words("cuff", half="manchette mi-longue", long="manchette longue|manchettes longues|long cuff", short="manchette courte|manchettes courtes|short cuff"), *flags(thermal_liner=_THERMAL, touch_screen="tactiles?|touch ?screen", ventilation=_AIR),
    ),
    "trousers": (
        *words("kind", jeans="jeans?", overtrousers="sur-?pantalon", leggings="leggings?", cargo="cargo", trousers="pantalons?|trousers"), *_RIDING, *_SEX, *words("material", denim="denim|jeans?", leather="cuir|leather", textile="textile", mesh="mesh"),
        *words("named fabric", armalith="armalith", kevlar="kevlar", cordura="cordura", dyneema="dyneema"), *flags(reinforced_fabric="armalith|cordura|dyneema|mati[eè]re renforc[eé]e", aramid=r"aramides?|kevlar"),
        *words("aramid extent", whole=r"(?:aramide|kevlar) int[eé]grale?|enti[eè]rement doubl[eé]", zones=r"(?:renforts?|empi[eè]cements?) (?:en )?(?:aramide|kevlar)"), *_CLASSES,
        *fittings(knee_protectors="genoux?|knees?", hip_protectors="hanches?|hips?"), *words("knee level", _2=r"genoux? (?:ce )?niveau 2", _1=r"genoux? (?:ce )?niveau 1"), *words("hip level", _2=r"hanches? (?:ce )?niveau 2", _1=r"hanches? (?:ce )?niveau 1"),
        *flags(adjustable_knees=r"(?:genouill[eè]res|genoux) r[eé]glables?", slider_room="sliders?", waterproof=_WET), *_MEMBRANE, *words("thermal liner", removable="doublure (?:thermique )?amovible", fixed="doublure (?:thermique )?fixe", there=_THERMAL), *_SEASON,
        *words("cut", skinny="skinny", slim="slim", tapered="tapered|fusel[eé]e?", loose="loose|ample", straight="droite?|regular|straight"), *flags(ventilation=_AIR, zip_to_jacket=r"zip de (?:liaison|raccordement)|connection zip", reflective=_SEEN, stretch="stretch|extensible"),
    ),
    "boots": (
        *words("material", leather_and_textile="cuir et textile|cuir[- ]textile", leather="cuir|leather", synthetic=r"microfibre|synth[eé]tique", textile="textile"), *words("kind", half_boots="demi-bottes?", trainers="baskets?|sneakers?", boots="bottes?|boots?"), *_RIDING, *_SEX,
        *words("height", high="montantes?|high", low="basses?|low"), *flags(waterproof=_WET), *_GORE, *fittings(ankle_protectors=r"mall[eé]oles?|chevilles?|ankles?", shin_protectors="tibias?|shins?"), *flags(shift_pad=r"s[eé]lecteur|shift pad"),
        *words("approval", EN_13634=r"en ?13634", CE=r"ce|homologu[eé]e?s?"), *(Rule(f"{n} index", rf"13634(?::20[0-9]{{2}})?[ :-]*(?:[12][ -]){{{k}}}([12])\b", least=1, most=2) for k, n in enumerate(("height", "abrasion", "cut", "rigidity"))), *_MEMBRANE,
        *flags(toe_cap="(?:coque|renfort)s? (?:de |au )?bout de pied|toe cap"), *words("closing", laces_and_zip="lacets? et (?:zip|fermeture)", laces="lacets?|laces?", zip="zip|fermeture [eé]clair", buckles="boucles?|buckles?", velcro="scratch|velcro"),
        *words("sole", vibram="vibram"), *flags(anti_slip_sole=r"(?:semelle )?antid[eé]rapante|non-slip", oil_resistant_sole="anti-?huile|r[eé]sistante aux hydrocarbures|oil resistant", ventilation=_AIR, reflective=_SEEN),
    ),
}
#: Beginnings of texts of accessories, which have none of their category's attributes.
SKIPPED = {"boots": r"^\s*(?:paires? de )?(?:chaussettes?|semelles?|lacets|cirage|spray|entretien)\b", "helmet": r"^\s*(?:[eé]cran|visi[eè]re|housse|support)\b"}


def attributes(df: DataFrame, key: str, text: str, category: str) -> DataFrame:
    """Long form (key, name, value): what each row's text says, without null readings."""
    rules = CATEGORIES[category]
    names = list(dict.fromkeys(r.name for r in rules))
    low = F.lower(F.regexp_replace(F.col(text), r"<[^>]*>", " "))
    rows = df.select(key, low.alias("_low")).where("_low is not null")
    if category in SKIPPED:
        rows = rows.where(~F.col("_low").rlike(SKIPPED[category]))
    rows = rows.withColumn("_clauses", F.split("_low", _CLAUSE))
    read = [F.struct(F.lit(n).alias("name"), F.coalesce(*[r.reading(F.col("_low"), F.col("_clauses")) for r in rules if r.name == n]).alias("value")) for n in names]
    return rows.select(key, F.explode(F.array(*read)).alias("x")).select(key, "x.name", "x.value").where("value is not null")


def merge_readings(readings: DataFrame, key: str, order: Sequence[str], strict: Sequence[str] = (), cautious: Sequence[str] = ()) -> DataFrame:
    """One value for each key and attribute: the first source's in a fixed order; strict ones only if all sources agree;
    of cautious ones, any value but "supplied" goes before it, whatever its source."""
    rank = F.coalesce(F.array_position(F.lit(list(order)), F.col("source")), F.lit(0))
    rank = F.when(rank == 0, len(order) + 1).otherwise(rank)
    rank = F.when(F.col("name").isin(list(cautious)) & (F.col("value") == "supplied"), rank + len(order) + 1).otherwise(rank)
    merged = readings.where("value is not null").groupBy(key, "name").agg(F.min(F.struct(rank.alias("r"), "value", "source")).alias("x"), F.count_distinct("value").alias("kinds"))
    return merged.where(~F.col("name").isin(list(strict)) | (F.col("kinds") == 1)).select(key, "name", "x.value", "x.source")
