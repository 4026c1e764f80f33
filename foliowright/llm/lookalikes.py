"""Letters of one script that look like letters of another."""

from __future__ import annotations

# Letters of other scripts above the Latin letters they pass for.
CYRILLIC_TO_LATIN: dict[str, str] = dict(zip("АВЕЅІЈКМНОРСТУХҮԌԚԜаеѕіјорсухһԁԛԝгԍҽ", "ABESIJKMHOPCTYXYGQWaesijopcyxhdqwrge"))
GREEK_TO_LATIN: dict[str, str] = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧαιγηκνορτυχωϲϳ", "ABEZHIKMNOPTYXaiynkvoptuxwcj"))
ARMENIAN_TO_LATIN: dict[str, str] = dict(zip("ՍՏՕհոսցօզ", "USOhnugoq"))
CHEROKEE_TO_LATIN: dict[str, str] = dict(zip("ᎪᏴᏟᎠᎬᏀᎻᏞᎷᏢᎡᏚᎢᏙᎳᎩᏃᎫᏦᏒ", "ABCDEGHLMPRSTVWYZJKR"))
LISU_TO_LATIN: dict[str, str] = dict(zip("ꓮꓐꓚꓓꓰꓝꓖꓧꓲꓙꓗꓡꓟꓠꓳꓑꓣꓢꓔꓴꓦꓪꓫꓬꓜ", "ABCDEFGHIJKLMNOPRSTUVWXYZ"))
# Latin letters of phonetic writing that look like plain ones.
PHONETIC_TO_LATIN: dict[str, str] = dict(zip("ɑɡᴄᴏꜱᴜᴠᴡᴢ", "agcosuvwz"))
# Latin letters and the Cyrillic and Greek ones they pass for.
LATIN_TO_CYRILLIC: dict[str, str] = dict(zip("ABEKMHOPCTYXSIJaecopxysij", "АВЕКМНОРСТУХЅІЈаесорхуѕіј"))
GREEK_TO_CYRILLIC: dict[str, str] = dict(zip("ΑΒΕΚΜΗΟΡΤΧαορ", "АВЕКМНОРТХаор"))
LATIN_TO_GREEK: dict[str, str] = dict(zip("ABEZHIKMNOPTYXov", "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧον"))

TO_LATIN: dict[str, str] = CYRILLIC_TO_LATIN | GREEK_TO_LATIN | ARMENIAN_TO_LATIN | CHEROKEE_TO_LATIN | LISU_TO_LATIN
TO_CYRILLIC: dict[str, str] = LATIN_TO_CYRILLIC | GREEK_TO_CYRILLIC
TO_GREEK: dict[str, str] = LATIN_TO_GREEK
LATIN_TWIN = str.maketrans(TO_LATIN)
