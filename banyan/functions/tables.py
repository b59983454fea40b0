"""Fixed values that results depend on."""

# Spelling variants and abbreviations, and what stands for them.
BANGLISH = {
    "valo": "bhalo", "balo": "bhalo", "kmn": "kemon", "kemne": "kemon kore", "kivabe": "kemon kore", "ki kori": "ki kori",
    "koro": "koro", "korchi": "korchi", "korchis": "korchis", "thik ache": "thik ache", "thik asi": "thik ache", "achi": "achi",
    "asi": "achi", "asos": "acho", "acho": "acho", "dhonnobad": "dhonnobad", "dhonnobaad": "dhonnobad", "onk": "onek",
    "onek": "onek", "koto": "koto", "ktoi": "koto", "bhai": "bhai", "vai": "bhai", "apu": "apu", "cutii": "cute",
}
ENGLISH = {
    "u": "you", "r": "are", "ur": "your", "pls": "please", "plz": "please", "thx": "thanks", "ty": "thank you", "gr8": "great",
    "b4": "before", "2day": "today", "tmrw": "tomorrow", "idk": "i don't know", "imo": "in my opinion", "btw": "by the way",
    "omg": "oh my god", "lol": "laughing out loud", "brb": "be right back", "asap": "as soon as possible", "lmk": "let me know",
    "tbh": "to be honest",
}
SLANG = {**BANGLISH, **ENGLISH}

# Bengali letters and their Latin forms.
VOWELS = {"অ": "o", "আ": "a", "ই": "i", "ঈ": "ii", "উ": "u", "ঊ": "uu", "ঋ": "ri", "এ": "e", "ঐ": "oi", "ও": "o", "ঔ": "ou"}
SIGNS = {"া": "a", "ি": "i", "ী": "ii", "ু": "u", "ূ": "uu", "ৃ": "ri", "ে": "e", "ৈ": "oi", "ো": "o", "ৌ": "ou"}
CONSONANTS = {
    "ক": "k", "খ": "kh", "গ": "g", "ঘ": "gh", "ঙ": "ng", "চ": "ch", "ছ": "chh", "জ": "j", "ঝ": "jh", "ঞ": "n", "ট": "t", "ঠ": "th",
    "ড": "d", "ঢ": "dh", "ণ": "n", "ত": "t", "থ": "th", "দ": "d", "ধ": "dh", "ন": "n", "প": "p", "ফ": "ph", "ব": "b", "ভ": "bh",
    "ম": "m", "য": "j", "র": "r", "ল": "l", "শ": "sh", "ষ": "sh", "স": "s", "হ": "h", "ৎ": "t",
}
VIRAMA = "্"
MARKS = {"ং": "ng", "ঃ": "h", "ঁ": "n"}
DIGITS = {"０": "0", "১": "1", "২": "2", "৩": "3", "৪": "4", "৫": "5", "৬": "6", "৭": "7", "৮": "8", "৯": "9", "০": "0"}
#: Letters with a dot below; as two code points they are read letter by letter unless asked otherwise.
NUKTA = {"ড়": "r", "ঢ়": "rh", "য়": "y"}

# Latin spellings in the order in which they are tried, and their Bengali forms.
LATIN = {
    "kh": "খ", "gh": "ঘ", "ch": "চ", "chh": "ছ", "jh": "ঝ", "th": "থ", "dh": "ধ", "ph": "ফ", "bh": "ভ", "sh": "শ", "ng": "ং",
    "rh": "ঢ়", "k": "ক", "g": "গ", "c": "চ", "j": "জ", "t": "ত", "d": "দ", "n": "ন", "p": "প", "f": "ফ", "b": "ব", "v": "ভ",
    "m": "ম", "y": "য়", "r": "র", "l": "ল", "s": "স", "h": "হ", "aa": "া", "ii": "ী", "uu": "ূ", "oi": "ৈ", "ou": "ৌ",
    "a": "া", "i": "ি", "u": "ু", "e": "ে", "o": "ো",
}
FIRST_VOWELS = {"a": "আ", "i": "ই", "u": "উ", "e": "এ", "o": "ও", "aa": "আ", "ii": "ঈ", "uu": "ঊ", "oi": "ঐ", "ou": "ঔ"}

# What models leave behind in texts, in the order of removal.
ARTIFACTS = ("<unk>", "<pad>", "<s>", "</s>")

# Names of languages and engines.
LANGUAGE_NAMES = {"bn2en": "English", "en2bn": "Bengali"}
REVERSE = {"bn2en": "en2bn", "en2bn": "bn2en"}
TARGET = {"bn2en": "en", "en2bn": "bn"}
ENGINE_CODES = {
    "indictrans2": {"bn": "ben_Beng", "en": "eng_Latn"},
    "nllb": {"bn": "ben_Beng", "en": "eng_Latn"},
    "banglat5": {"bn": "bn", "en": "en"},
}
