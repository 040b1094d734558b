"""Word lists of name normalisation. Results depend on each of them."""

from __future__ import annotations

# fixed values
GIVEN_PREFIXES = (
    "da", "de", "del", "la", "los",
)

# fixed values
BEGINNING_SURNAME_PREFIXES = (
    "e", "o",
)

# fixed values
SURNAME_PREFIXES = (
    "a", "ab", "abu", "af", "al", "alam", "alt", "an", "ap", "ar", "aust", "austre", "av", "bar", "beau", "ben", "bent", "bin", "bint", "d",
    "da", "dal", "dalla", "das", "de", "degli", "del", "dela", "dele", "dell", "della", "delle", "dello", "delo", "delos", "dem", "den", "der",
    "des", "desaint", "dest", "di", "do", "dos", "du", "el", "en", "erch", "fetch", "fits", "fitz", "gil", "h", "hen", "ibn", "kil", "l", "la",
    "le", "lille", "lo", "loon", "los", "m", "ma", "mac", "mack", "mc", "mck", "me", "mellom", "mhic", "mic", "myljom", "n", "ned", "neder",
    "nedre", "ni", "nic", "nord", "nordre", "norr", "ny", "ofver", "opp", "ost", "oster", "ostre", "over", "ovre", "ovste", "pour", "saint",
    "sainte", "san", "santa", "soder", "sonder", "sondre", "sor", "sore", "st", "sta", "ste", "stor", "syd", "syndre", "t", "te", "ten", "ter",
    "tre", "ua", "ui", "upp", "v", "val", "van", "vande", "vanden", "vander", "vast", "vaster", "vda", "ver", "verch", "vesle", "vest",
    "vestre", "vetch", "vetle", "viuda", "vom", "von", "vonder", "vor", "w", "zu",
)

# fixed values: abbreviation and given name
GIVEN_ABBREVIATIONS = {
    "abr": "abraham", "alex": "alexander", "alexr": "alexander", "ant": "anthony", "art": "arthur", "aug": "augustus", "bart": "bartholomew",
    "benj": "benjamin", "chas": "charles", "danl": "daniel", "deb": "deborah", "den": "dennis", "edw": "edward", "edwd": "edward", "elisab":
    "elisabeth", "eliz": "elizabeth", "elizth": "elizabeth", "franco": "francisco", "geo": "george", "hel": "helen", "hen": "henry", "jac":
    "jacob", "jas": "james", "jn": "john", "jno": "john", "joh": "johann", "jon": "jonathan", "jos": "joseph", "ma": "maria", "margt":
    "margaret", "matt": "matthew", "mich": "michael", "michl": "michael", "my": "mary", "nath": "nathaniel", "ol": "oliver", "patk": "patrick",
    "patt": "patrick", "pet": "peter", "phil": "philip", "ric": "richard", "richd": "richard", "robt": "robert", "saml": "samuel", "sar":
    "sarah", "sim": "simon", "sol": "solomon", "sus": "susan", "tho": "thomas", "thos": "thomas", "tim": "timothy", "urs": "ursula", "willm":
    "william", "wm": "william",
}

# fixed values
NOISE_WORDS = (
    "1st", "2nd", "3rd", "4th", "5th", "6th", "7th", "8th", "9th", "and", "baby", "capt", "col", "corp", "cpl", "daughter", "deceased", "dit",
    "ditto", "dr", "e", "esq", "father", "fnu", "fr", "gen", "husband", "ii", "iii", "illegible", "in", "inconnue", "infant", "inlaw", "iv",
    "jr", "jun", "known", "lnu", "lt", "maj", "miss", "mister", "mme", "mother", "mr", "mrs", "nascimento", "nd", "nee", "nn", "null", "o",
    "of", "or", "pfc", "priv", "private", "pvt", "rd", "rev", "sen", "senr", "sgt", "son", "spouse", "spouses", "sr", "stillborn", "surname",
    "tbd", "th", "unk", "unkn", "unknow", "unknowen", "unknown", "unkown", "unkwn", "unnamed", "unreadable", "unrecorded", "widow", "wife", "y",
)

# fixed values
POSSIBLE_NOISE_WORDS = (
    "baron", "bishop", "blank", "brother", "buin", "captain", "chief", "colonel", "coroner", "corporal", "count", "deacon", "doctor", "duke",
    "earl", "elder", "fujin", "general", "governor", "judge", "king", "know", "lady", "lieutenant", "living", "lord", "major", "master",
    "mayor", "md", "minister", "named", "no", "officer", "pastor", "president", "prince", "princess", "queen", "rabbi", "reverend", "senator",
    "senior", "sergeant", "sheriff", "sir", "sister", "ssi", "the", "twin",
)

# fixed values
POSSIBLE_SURNAME_NOISE_WORDS = (
    "junior", "ui",
)

# fixed values, in this order: pattern and replacement
PATRONYMICS = (
    ("(son|ssen|sson|sen|sdr|sdtr|sdt|sd|sdatter|sdattir|sdattor|sdaatter|sdaattir|sdaattor|sdater|sdatir|sdator|sdotter|sdottir|sdottor|sdoter|sdotir|sdotor|dr|dtr|datter|dattir|dattor|daatter|daattir|daattor|dater|datir|dator|dotter|dottir|dottor|doter|dotir|dotor)$", "son"),
    ("ovna$", "ovich"),
    ("evna$", "evich"),
    ("(inichna|ichna)$", "ich"),
)
