"""Prose for the fixtures."""

WORDS = {
    "en": "the of and to in is that for it was on are as with his they at be this from have or by one had not but what all were when we there can an your which their said if do into has more her two like him see time could no make than first been its who now people my made over did down only way find use may water long little very after words called just where most know".split(),
    "de": "der die das und ist nicht ein eine zu den mit von sich auf für dem auch als es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man sein wurde sei ihre unter wenn kann gegen vom können schon".split(),
    "fr": "le de un être et à il avoir ne je son que se qui ce dans en du elle au pour pas que vous par sur faire plus dire me on mon lui nous comme mais pouvoir avec tout y aller voir en bien où sans tu ou leur homme si deux mari moi vouloir te femme venir quand grand celui".split(),
}
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, lang, n):
    words = [rng.choice(WORDS[lang]) + rng.choice(["", "", rng.choice(WORDS[lang])]) for _ in range(n)]
    return " ".join(w + ("." if i % 9 == 8 else "") for i, w in enumerate(words))
