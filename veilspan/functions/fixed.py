"""Patterns, word lists, tags, thresholds that results depend on.

These must stay exactly as they are for results to be comparable; they are data, not logic. Three
rule variants exist side by side (A, B, C) and differ on purpose: exchange rate, band edges, year
ranges and overlap policy are kept per variant.
"""
from __future__ import annotations

from veilspan.functions.regexes import rx

# ------------------------------------------------------------------ fixed values, variant A
A_TAGS = {
    "email": "[correo]", "dpi": "[DPI]", "nit": "[NIT]", "phone": "[teléfono]",
    "employer": "[empleador actual]", "name": "[nombre]", "salary": "[monto]", "money": "[monto]",
}
A_PRIORITY = {"email": 0, "dpi": 1, "nit": 2, "phone": 3, "employer": 4, "name": 5, "salary": 6, "money": 7}

A_NUM = r"(?:\d{1,3}(?:[.,\u00a0\u202f ]\d{3})+(?:[.,]\d{1,2})?|\d+(?:[.,]\d{1,2})?)"
A_SCALE = r"(?:\s?(?:k|mil|millones|millón|millon)(?![\p{L}\p{N}]))"
A_PREFIX = r"(?:US\s?\$|USD|GTQ|Q\.?|\$)"
A_SUFFIX = r"(?:quetzales|quetzal|dólares|dolares|USD|GTQ)"
A_NUMBER_WORDS = (
    "un|uno|dos|tres|cuatro|cinco|seis|siete|ocho|nueve|diez|once|doce|trece|catorce|quince|dieciséis|"
    "dieciseis|diecisiete|dieciocho|diecinueve|veinte|veinti[\\p{L}]+|treinta|cuarenta|cincuenta|sesenta|"
    "setenta|ochenta|noventa|cien|ciento|doscientos|trescientos|cuatrocientos|quinientos"
)
A_EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
A_DPI = rx(r"(?<!\d)\d{4}[\s-]?\d{5}[\s-]?\d{4}(?!\d)")
A_NIT_LABELED = rx(r"\bNIT\b\s*[:#.]?\s*\d[\d-]{3,}[\dkK]?(?![\dkK])", "i")
A_NIT_BARE = r"(?<![\d-])\d{5,9}-[\dkK](?![\dA-Za-z-])"
A_PHONE = rx(r"(?:(?:\+|00)?\(?502\)?[\s-]?[2-7]\d{3}[\s-]?\d{4}|(?<!\d)[2-7]\d{3}[\s-]?\d{4})(?!\d)")
A_MONEY_PREFIX = rx(rf"(?<![\p{{L}}\p{{N}}]){A_PREFIX}\s?{A_NUM}{A_SCALE}?", "i")
A_MONEY_SUFFIX = rx(rf"(?<![\p{{N}}.,]){A_NUM}{A_SCALE}?\s?{A_SUFFIX}(?![\p{{L}}])", "i")
A_MONEY_SCALE = rx(rf"(?<![\p{{N}}.,]){A_NUM}{A_SCALE}", "i")
A_MONEY_WORDS = rx(rf"(?<![\p{{L}}])(?:{A_NUMBER_WORDS})(?:\s+y\s+(?:{A_NUMBER_WORDS}))?\s+mil(?![\p{{L}}])", "i")
A_GROUPED = r"(?<![\d.,])\d{1,3}(?:[.,\u00a0\u202f ]\d{3})+(?:[.,]\d{1,2})?(?![\d])"
A_BARE = r"(?<![\d.,])\d{4,}(?:[.,]\d{1,2})?(?![\d])"
A_ANY_NUMBER = rx(rf"(?<![\p{{N}}.,]){A_NUM}{A_SCALE}?", "i")
A_LEGAL_SUFFIX = rx(
    r"\b(s\.?\s?a\.?(\s?de\s?c\.?\s?v\.?)?|s\.?\s?r\.?\s?l\.?|ltda\.?|inc\.?|llc|corp\.?|cia\.?|compania|limitada)\s*$",
    "i",
)
A_YEARS = (1900, 2099)
A_SENTENCE_SPLIT = rx(r"(?<=[.!?;])\s+|\n+")

# ------------------------------------------------------------------ fixed values, variant B
B_TAGS = {
    "email": "[CORREO]", "dpi": "[DPI]", "nit": "[NIT]", "phone": "[TELÉFONO]", "money": "[MONTO]",
    "employer": "[EMPLEADOR_ACTUAL]", "currency_word": "[MONEDA]",
}
B_EMAIL = r"[\p{L}\d._%+-]+@[\p{L}\d.-]+\.[\p{L}]{2,}"
B_DPI = r"(?<!\d)\d{4}[ \-]?\d{5}[ \-]?\d{4}(?!\d)"
B_NIT = rx(r"\bNIT\b\s*[:#.]?\s*[\dkK][\d\-]{3,}[\dkK]?|(?<![\d\-])\d{5,8}-[\dkK](?![\p{L}\d])", "i")
B_PHONE = r"(?<![\d+])(?:\+?\(?502\)?[ \-]?)?[2-7]\d{3}[ \-]?\d{4}(?!\d)"
B_CURRENCY_WORD = rx(r"(?<![\p{L}])(?:quetzales|quetzal|d[oó]lares)(?![\p{L}])", "i")
B_LEGAL_SUFFIX = rx(r"[,\s]*(?:s\.?\s?a\.?|ltda\.?|inc\.?|corp\.?|s\.?\s?de\s?r\.?\s?l\.?|llc)\s*$", "i")
B_GENERIC_EMPLOYER = (
    "grupo banco corporacion compania empresa empresas colegio hospital constructora distribuidora farmacias "
    "farmacia almacenes bufete guatemala guatemalteca centroamerica centroamericana industrial nacional "
    "internacional sociedad anonima servicios soluciones tecnologia comercial americano americana general global "
    "consultores consultoria asociados universidad instituto ministerio municipalidad fundacion clinica tienda "
    "tiendas cooperativa latam group bank company solutions services the and"
).split()
_NB = r"[ \u00a0]"
B_NUM = (
    rf"\d{{1,3}}(?:(?:,|\.|{_NB}(?=\d{{3}}(?!\d)))\d{{3}})+(?:[.,]\d{{1,2}}(?!\d))?|\d+(?:[.,]\d{{1,2}}(?!\d))?"
)
B_PRE = rf"(?:GTQ|USD|US\$|Q\.?|\$){_NB}?"
B_MULT = rf"{_NB}?(?:[kK]|mil)(?![\p{{L}}\d])"
B_SUF = rf"{_NB}?(?:quetzales|quetzal|GTQ|USD|d[oó]lares|dólar|dolar|dls\.?)(?![\p{{L}}])"
# groups: prefix, number, multiplier, suffix
B_MONEY = (
    rf"(?<![\p{{L}}\d.,])({B_PRE})?({B_NUM})({B_MULT})?({B_SUF})?(?![\p{{L}}\d%])(?!{_NB}?%)"
)
B_NUMBER_WORDS = {
    "un": 1, "uno": 1, "dos": 2, "tres": 3, "cuatro": 4, "cinco": 5, "seis": 6, "siete": 7, "ocho": 8,
    "nueve": 9, "diez": 10, "once": 11, "doce": 12, "trece": 13, "catorce": 14, "quince": 15,
    "dieciseis": 16, "dieciséis": 16, "diecisiete": 17, "dieciocho": 18, "diecinueve": 19, "veinte": 20,
    "veintiuno": 21, "veintidos": 22, "veintidós": 22, "veintitres": 23, "veintitrés": 23,
    "veinticuatro": 24, "veinticinco": 25, "veintiseis": 26, "veintiséis": 26, "veintisiete": 27,
    "veintiocho": 28, "veintinueve": 29, "treinta": 30, "cuarenta": 40, "cincuenta": 50, "sesenta": 60,
    "setenta": 70, "ochenta": 80, "noventa": 90, "cien": 100, "ciento": 100,
}
_BW = "|".join(sorted(B_NUMBER_WORDS, key=lambda w: -len(w)))
# groups: first word, second word, suffix
B_SPELLED = rx(
    rf"(?<![\p{{L}}])({_BW})(?:\s+y\s+({_BW}))?\s+mil(?![\p{{L}}])(\s+(?:quetzales|d[oó]lares))?", "i"
)
B_YEARS = (1950, 2099)
B_KNOWN_ABS, B_KNOWN_REL = 0.5, 0.001
B_PERCENT = rx(r"(?<![\d.,])(\d{1,3}(?:[.,]\d{1,2})?)\s?(?:%|por ?ciento|percent)", "i")
AMOUNT_TOLERANCE, PERCENT_TOLERANCE = 0.02, 1.0
HUMAN_WORDS = {
    "es": {
        "[MONTO]": "un monto significativo", "[EMPLEADOR_ACTUAL]": "mi empleador actual", "[CORREO]": "",
        "[TELÉFONO]": "", "[DPI]": "", "[NIT]": "", "[MONEDA]": "",
    },
    "en": {
        "[MONTO]": "a significant amount", "[EMPLEADOR_ACTUAL]": "my current employer", "[CORREO]": "",
        "[TELÉFONO]": "", "[DPI]": "", "[NIT]": "", "[MONEDA]": "",
    },
}

# ------------------------------------------------------------------ fixed values, variant C
C_TAGS = {
    "salary": "[SALARIO]", "employer": "[EMPLEADOR_ACTUAL]", "person_name": "[PERSONA]", "phone": "[TELÉFONO]",
    "email": "[CORREO]", "dpi": "[DPI]", "address": "[DIRECCIÓN]", "nit": "[NIT]",
}
C_NAME_TAG = "{{NOMBRE}}"
C_TAG_PATTERN = r"\[[A-ZÁÉÍÓÚ_]+\]|\{\{NOMBRE\}\}"
C_PRIORITY = {
    "email": 0, "dpi": 1, "nit": 2, "phone": 3, "salary": 4, "address": 5, "employer": 6, "person_name": 7,
}
C_NUM = r"\d{1,3}(?:[.,\s']\d{3})+(?:[.,]\d{1,2})?(?!\d)|\d+(?:[.,]\d+)?(?!\d)"
C_PREFIX = r"(?:GTQ|US\$|USD|U\$S|\$|Q\.?|quetzales)"
C_MULT = r"(?:k|K|mil)(?![a-záéíóúñ])"
C_CUR_SUFFIX = r"(?:quetzales|quetzal|d[óo]lares|d[óo]lar|USD|GTQ|dls\.?)(?![a-záéíóúñ])"
C_NUMBER_WORD = (
    "un|uno|dos|tres|cuatro|cinco|seis|siete|ocho|nueve|diez|once|doce|trece|catorce|quince|diecis[eé]is|"
    "diecisiete|dieciocho|diecinueve|veinte|veinti[uú]n|veintid[oó]s|veintitr[eé]s|veinticuatro|veinticinco|"
    "veintis[eé]is|veintisiete|veintiocho|veintinueve|treinta|cuarenta|cincuenta|sesenta|setenta|ochenta|"
    "noventa|cien|ciento|doscientos|trescientos|cuatrocientos|quinientos|seiscientos|setecientos|ochocientos|"
    "novecientos"
)
C_WORDS_AMOUNT = rx(
    rf"\b(?:(?:{C_NUMBER_WORD})(?:\s+y\s+(?:{C_NUMBER_WORD}))?\s+)?mil(?![a-záéíóúñ])"
    rf"(?:\s+(?:{C_NUMBER_WORD})(?![a-záéíóúñ]))*(?:\s+{C_CUR_SUFFIX})?",
    "i",
)
C_COUNT_NOUNS = rx(
    r"^\s*(?:\+?\s*)?(?:usuari[oa]s?|clientes?|personas?|transacciones|descargas|registros|horas|visitas|empleados|"
    r"colaboradores|estudiantes|alumnos|productos|pedidos|tickets|solicitudes|l[ií]neas|km|metros|m2|unidades|"
    r"seguidores|suscriptores|users|customers|downloads|requests|records|hours|downloads|piezas|casos|expedientes|"
    r"facturas|p[aá]ginas|beneficiarios|pacientes|socios|tiendas|agencias|sucursales|puntos)",
    "i",
)
# groups: number, multiplier, currency
C_MONEY_A = rx(rf"{C_PREFIX}\s?({C_NUM})(\s?{C_MULT})?(\s?{C_CUR_SUFFIX})?", "i")
C_MONEY_B = rx(rf"(?<![\w$])({C_NUM})\s?{C_MULT}(\s?{C_CUR_SUFFIX})?", "i")
C_MONEY_C = rx(rf"(?<![\w$])({C_NUM})\s?{C_CUR_SUFFIX}", "i")
C_MONEY_E = rx(rf"(?<![\w$.,])({C_NUM})")
C_NUMBER_VALUES = {
    "un": 1, "uno": 1, "dos": 2, "tres": 3, "cuatro": 4, "cinco": 5, "seis": 6, "siete": 7, "ocho": 8,
    "nueve": 9, "diez": 10, "once": 11, "doce": 12, "trece": 13, "catorce": 14, "quince": 15, "dieciseis": 16,
    "diecisiete": 17, "dieciocho": 18, "diecinueve": 19, "veinte": 20, "veintiun": 21, "veintidos": 22,
    "veintitres": 23, "veinticuatro": 24, "veinticinco": 25, "veintiseis": 26, "veintisiete": 27,
    "veintiocho": 28, "veintinueve": 29, "treinta": 30, "cuarenta": 40, "cincuenta": 50, "sesenta": 60,
    "setenta": 70, "ochenta": 80, "noventa": 90, "cien": 100, "ciento": 100, "doscientos": 200,
    "trescientos": 300, "cuatrocientos": 400, "quinientos": 500, "seiscientos": 600, "setecientos": 700,
    "ochocientos": 800, "novecientos": 900,
}
C_YEARS = (1950, 2039)
C_CORPORATE_SUFFIX = rx(
    r"(?:[,\s]*(?<![A-Za-z0-9_])(?:s\.?\s?a\.?|sociedad an[oó]nima|ltda\.?|limitada|inc\.?|corp\.?|llc|s\.?\s?de\s?r\.?\s?l\.?)\s*)+$",
    "i",
)
C_STOP = "de del la las los el y e en & the of and".split()
C_GENERIC = (
    "banco grupo corporacion empresa compania servicios soluciones sistemas tecnologia tecnologias guatemala "
    "guatemalteca guatemalteco centroamerica centroamericana americana centro internacional industrial digital "
    "software consultores consultoria group bank solutions services technologies global nacional distribuidora "
    "comercial comercializadora agencia agencias fundacion asociacion universidad colegio hospital clinica "
    "ministerio municipalidad cooperativa financiera seguros aseguradora inversiones industrias labs"
).split()
C_TOKEN = r"[\p{L}\p{N}&]+"
_UP, _LOW = "A-ZÁÉÍÓÚÑÜ", "a-záéíóúñü"
C_NAME = f"[{_UP}][{_LOW}]+(?:-[{_UP}][{_LOW}]+)?"
C_ROLES = (
    "jefe jefa gerente compañero compañera compañeros colega supervisor supervisora director directora coordinador "
    "coordinadora líder lider manager boss mentor mentora cliente socio socia encargado encargada reclutador "
    "reclutadora recruiter contacto referencia jefecito teammate coworker"
).split()
C_TITLES = (
    r"Lic\. Licda\. Licenciado Licenciada Ing\. Inga\. Ingeniero Ingeniera Dr\. Dra\. Doctor Doctora Sr\. Sra\. Srta\. "
    r"Señor Señora Don Doña Arq\. Mr\. Mrs\. Ms\. Msc\. MSc\."
).split()
_ROLE = "|".join(f"[{w[0].upper()}{w[0]}]{w[1:]}" for w in C_ROLES)
C_PERSON_ROLE = rx(
    rf"\b(?:{_ROLE})(?:[ \t]+(?:de|del|en)[ \t]+[{_LOW}]+)?[ \t]*[,:(]?[ \t]+({C_NAME}(?:[ \t]+{C_NAME}){{0,2}})"
)
C_PERSON_TITLE = rx(rf"(?:{'|'.join(C_TITLES)})[ \t]+({C_NAME}(?:[ \t]+{C_NAME}){{0,2}})")
C_NOT_NAMES = (
    "general regional senior junior tecnico tecnica comercial ventas operaciones proyecto proyectos ti it "
    "financiero financiera administrativo administrativa recursos humanos marketing producto ingenieria desarrollo "
    "calidad soporte area equipo tienda sucursal planta logistica contabilidad finanzas data qa de del en y the of "
    "product engineering sales tech lead principal interino interina nacional pais country mi su"
).split()
C_JOB_WORDS = (
    "react native backend frontend fullstack software sistemas datos cloud devops mobile web java python industrial "
    "civil quimico quimica electronico electronica mecanico mecanica agronomo agronoma administracion contaduria "
    "mercadotecnia psicologia derecho enfermeria medicina auditoria economia informatica computacion"
).split()
C_EMAIL = r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+"
C_DPI = rx(r"(?<!\d)\d{4}[\s-]?\d{5}[\s-]?\d{4}(?!\d)")
C_NIT_LABELED = rx(
    r"\bNIT\s*(?:No\.?|#|:)?\s*:?\s*(\d{1,3}(?:[.,]?\d{3}){1,3}\s*-?\s*[\dkK]|\d{5,9}-?[\dkK])(?![\w])", "i"
)
C_NIT_SHAPE = r"(?<![\d-])\d{6,8}-[\dkK](?![\w-])"
C_PHONE = rx(r"(?:\+?\(?502\)?[\s.-]?)?(?<![\d-])[2-7]\d{3}[\s.-]?\d{4}(?![\d-])")
C_ADDRESS = {
    "address_zona": rx(r"\bzona\s*\d{1,2}\b", "i"),
    "address_street_numbered": rx(
        r"\b\d{1,2}[ \t]*(?:a\.?|ª|°|era\.?|ra\.?|da\.?|ta\.?|va\.?|ma\.?|na\.?)?[ \t]*(?:calle|avenida|av\.)"
        r"(?:[ \t]+(?:[A-Z][ \t]+)?\d{1,3}[ \t]*-[ \t]*\d{1,3})?",
        "i",
    ),
    "address_street_named": rx(
        r"\b(?:[Cc]alle|[Aa]venida|[Aa]v\.|[Dd]iagonal|[Bb]ulevar|[Bb]oulevard|[Bb]lvd\.?|[Cc]alzada|[Cc]allej[oó]n|"
        r"[Cc]arretera)[ \t]+(?:a[ \t]+)?[\p{Lu}\d][\p{L}\d.-]*(?:[ \t]+[\p{Lu}][\p{L}]+)?(?:[ \t]+\d{1,3}[ \t]*-[ \t]*\d{1,3})?"
    ),
    "address_km": rx(r"\b(?:km\.?|kil[oó]metro)\s*\d{1,3}(?:[.,]\d)?\b", "i"),
    "address_area": rx(
        r"\b(?:[Cc]olonia|[Cc]ol\.|[Rr]esidenciales|[Rr]esidencial|[Cc]ondominio|[Bb]arrio|[Aa]ldea|[Ll]otificaci[oó]n|"
        r"[Cc]ant[oó]n)[ \t]+(?:(?:[Ll]os|[Ll]as|[Ee]l|[Ll]a|[Ss]an|[Ss]anta)[ \t]+)?[\p{Lu}][\p{L}]+(?:[ \t]+[\p{Lu}][\p{L}]+){0,2}"
    ),
    "address_unit": rx(r"\b(?:casa|apto\.?|apartamento|lote|manzana)\s*(?:no\.?|#|número)?\s*\d+[a-z]?\b", "i"),
    "address_house_number": rx(r"(?<![\d\w-])\d{1,2}\s*-\s*\d{2}(?=\s*,?\s*zona\b)", "i"),
}
LEAK_STOP_TOKENS = (
    "distribuidora banco grupo hospital colegio seguros farmacias cerveceria centro americana guatemala calle avenida "
    "zona colonia residenciales carretera salvador lopez"
).split()
SPANISH_UNITS = (
    "cero un dos tres cuatro cinco seis siete ocho nueve diez once doce trece catorce quince dieciseis diecisiete "
    "dieciocho diecinueve veinte veintiun veintidos veintitres veinticuatro veinticinco veintiseis veintisiete "
    "veintiocho veintinueve"
).split()
SPANISH_TENS = {3: "treinta", 4: "cuarenta", 5: "cincuenta", 6: "sesenta", 7: "setenta", 8: "ochenta", 9: "noventa"}
SPANISH_HUNDREDS = {
    1: "ciento", 2: "doscientos", 3: "trescientos", 4: "cuatrocientos", 5: "quinientos", 6: "seiscientos",
    7: "setecientos", 8: "ochocientos", 9: "novecientos",
}

# ------------------------------------------------------------------ fixed values, generic pack for volume data
G_EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
G_PHONE = r"\+1 \([0-9]{3}\) 555-[0-9]{4}"
G_ID16 = r"(?<![0-9])[0-9]{16}(?![0-9])"
G_SECRET = r"token = \"[^\"\n]+\""

# ------------------------------------------------------------------ fixed values, money and advice
FX = {"A": 7.75, "B": 7.7, "C": 7.7}
HOURS_PER_MONTH = (40 * 52) / 12
DAYS_PER_MONTH = (5 * 52) / 12
WEEKS_PER_MONTH = 52 / 12
CACHE_TTL_DAYS = 7
SLOW_MS = {"company": 3000, "market": 3000, "letter": 10000}
MAX_ACHIEVEMENTS, MAX_OFFER, MAX_SNIPPET = 2000, 4000, 350
PRICE_IN_PER_M, PRICE_OUT_PER_M = 0.75, 3.75
# band id, lower edge, upper edge, upper edge inclusive
BANDS = {
    "A": [("below", None, 0, False), ("conservative", 0, 10, False), ("realistic", 10, 30, True),
          ("ambitious", 30, 60, True), ("out_of_range", 60, None, False)],
    "B": [("recorte", None, 0, False), ("conservador", 0, 10, False), ("razonable", 10, 20, False),
          ("ambicioso", 20, 35, False), ("agresivo", 35, None, False)],
    "C": [("recorte", None, 0, False), ("conservadora", 0, 10, False), ("razonable", 10, 25, False),
          ("ambiciosa", 25, 40, False), ("muy_ambiciosa", 40, None, False)],
}
YEARS_BUCKETS = [
    ("LESS_THAN_ONE", "lt", 1), ("ONE_TO_THREE", "le", 3), ("FOUR_TO_SIX", "le", 6), ("SEVEN_TO_NINE", "le", 9),
    ("TEN_TO_FOURTEEN", "le", 14), ("ABOVE_FIFTEEN", None, None),
]
SENIORITY_BY_YEARS = [("lead", 10), ("senior", 5), ("semi-senior", 2), ("junior", 0)]
LANG_ES = "de la que el en y los las para con una por del se experiencia años requisitos conocimientos".split()
LANG_EN = "the and of to you with for our we is are will experience years requirements skills".split()
KEYWORD_STOPWORDS = (
    "para como pero porque sobre entre desde hasta donde cuando mientras tambien ademas nuestro nuestra nuestros "
    "nuestras usted ustedes ellos ellas este esta estos estas aquel aquella tener tiene tienen sera seran puede pueden "
    "debe deben forma parte cada todos todas otro otra otros otras mismo misma mucho mucha muy mas menos sera siendo "
    "estar estamos buscamos buscando ofrecemos requisitos requerimos deseable indispensable empresa puesto trabajo "
    "equipo experiencia anos minimo minima conocimiento conocimientos manejo nivel area areas about with from that "
    "this will have your their they which would there other into more than such been years experience team work role "
    "company requirements required preferred skills ability strong using including within across plus must should "
    "candidate candidates looking join guatemala salario sueldo enviar correo interesados aplicar beneficios "
    "prestaciones ley lunes viernes horario"
).split()
BULLET = rx(r"^\s*(?:[-*•·▪◦–]|\d+[.)])\s+(.{3,160})$")
OFFER_BULLET = rx(r"^\s*[-•·*–]\s+|^\s*\d+[.)]\s+")
OFFER_BULLET_HEAD = rx(r"^\s*(?:[-•·*–]|\d+[.)])\s+")
PERMUTATIONS = [
    ("local", "nube", "plantilla"), ("nube", "plantilla", "local"), ("plantilla", "local", "nube"),
    ("local", "plantilla", "nube"), ("nube", "local", "plantilla"), ("plantilla", "nube", "local"),
]
