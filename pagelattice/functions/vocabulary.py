"""Words and patterns that types are told by. Fixed values, all of them."""

TYPES = ("MODEL", "SIZE_HEADER", "KW_HEADER", "UNIT", "NUMERIC", "SECTION", "SPEC_LABEL", "TEXT")

# Units of measurement, lower case. Fixed values.
UNITS = (
    "kw", "db(a)", "dba", "mm", "kg", "l", "l/h", "m3/h", "m³/h", "m",
    "inch", "a", "v", "hz", "mm²", "mm2", "°c", "w", "%", "ø",
    "pa", "hp", "m³/min", "m3/min", "hz/v", "°cbs", "°cbu",
    "-", "- / kg", "rpm", "bar", "kwh", "kw/h", "mpa",
    "cfm", "btu/h", "kcal/h", "g/h", "ml/h",
)

# Units of the base typing, which knows fewer and other ones. Fixed values.
BASE_UNITS = (
    "kw", "w", "db", "db(a)", "dba", "kg", "mm", "v", "a", "hz",
    "kpa", "pa", "kwh", "l/h", "m³/h", "m3/h", "rpm", "l/s",
    "btu/h", "kbtu/h", "kcal/h", "mpa", "bar", "°c", "l",
)

# Words that mark a specification's label. Fixed values.
LABEL_WORDS = (
    "capacità", "potenza", "pressione", "portata", "efficienza",
    "assorbimento", "prevalenza", "deumidificazione",
    "seer", "scop", "cop", "eer", "eseer", "iplv",
    "classe", "eta", "gwp",
    "sonora", "rumore", "rumorosità",
    "dimensioni", "peso", "massa", "altezza", "larghezza",
    "profondità", "lunghezza", "diametro", "sezione", "volume",
    "compressore", "ventilatore", "scambiatore", "filtro",
    "pannello", "pannellatura", "serbatoio", "vaso",
    "motore", "griglia", "pompa", "valvola",
    "refrigerante", "carica", "precarica",
    "alimentazione", "corrente", "fusibile", "tensione",
    "attacchi", "connessione", "collegament", "tubazioni", "condensa",
    "scarico", "finitura",
    "controller", "telecomando", "comando",
    "range", "temperatura", "temp",
    "riscaldatore", "backup",
    "campo", "nominale", "regime", "spunto",
    "prezzo", "codice",
    "raffrescamento", "riscaldamento", "combinazione",
    "stagionale",
)

# Parts of long labels. Fixed values.
LABEL_PARTS = (
    "riscald", "raffredd", "inerzial", "espansion", "attacchi",
    "operativ", "conduttor", "frigorifer", "elettric", "sonor",
    "assorbita", "collegabil", "funzionam", "tubazion",
    "potenza sonora", "pressione sonora", "campo di",
    "sanitario", "backup", "serbatoio",
    "nominale", "condensa", "accoppiament", "impostabil",
    "campo operativ",
    "cooling", "heating", "capacity", "airflow", "noise",
    "weight", "dimension", "refrigerant", "power supply",
    "sound pressure", "sound power",
    "nominal", "drain", "piping", "wiring",
)

# Words that mark a section's heading. Fixed values.
SECTION_WORDS = (
    "performance", "prestazioni", "dati", "caratteristiche",
    "moduli", "circuito", "unità", "panoramica", "tecnici",
    "specifiche", "generale", "riepilogo",
    "specifications", "technical", "general", "overview",
    "features", "summary",
)

# Patterns of advertising and navigation, which are plain text; case plays no part. Fixed values.
EXCLUDED = (r"^Fai\s+clic", r"^accedere\s+ai", r"^NOVITÀ$", r"^tecnici:$", r"^pag\.?\s*\d+$", r"^www\.", r"^https?://")

# Model codes by brand, in order of precedence of brands: patterns of models in which case counts, those in which it
# doesn't, and likewise for sizes. Fixed values.
BRANDS = {
    "hitachi": {
        "model": (
            r"^RAK-[A-Z]{1,3}\d{2}", r"^RAC-[A-Z]{1,3}\d{2}", r"^RAM-\d{2}", r"^RAD-\d{2}", r"^RAF-", r"^RAI-",
            r"^RPI[LH]?-", r"^RPK-", r"^RPC-", r"^RPF[I]?-", r"^RCI[M]?-", r"^RCD-", r"^RNC-",
            r"^RAS-\d", r"^RASM-",
            r"^RWM-", r"^RWD-", r"^RWH-", r"^RWLT-", r"^HWM-", r"^HWD-",
            r"^DHWT-", r"^KPI-", r"^RCME-", r"^PC-AR",
            r"^ATW-", r"^SPX-", r"^CH-AP", r"^AG-", r"^MH-", r"^DBS-", r"^RHMA", r"^RASC-",
            r"^R[A-Z]{2}-[A-Z]{0,2}\d",
        ),
        "model_any_case": (), "size": (), "size_any_case": (),
    },
    "daikin": {
        "model": (),
        "model_any_case": (
            r"^FX[A-Z]{2}[\s-]", r"^FX[A-Z]{2}\d", r"^FX[A-Z]{2}$",
            r"^FTXM\d", r"^FTXA\d", r"^CTXM\d", r"^CTXA\d", r"^FDXM-",
            r"^RXYQ", r"^RXYS[A-Z]", r"^RXYN[\s-]?B$", r"^RXYA\d", r"^RXYLQ", r"^RXMLQ", r"^RWEYQ", r"^REYQ", r"^REYA\d",
            r"^RZAG", r"^RZASG", r"^AZAS", r"^FBA-", r"^FFA-", r"^FCAG-",
            r"^RXJ\d", r"^RXM\d", r"^RXZ\d",
            r"^E[BPRK][A-Z]{2}", r"^ERST", r"^ERPT",
            r"^BRC", r"^BEV\d", r"^BYCQ", r"^EKMBP", r"^EWYE",
            r"^CYAL", r"^CYAM", r"^CYAS",
        ),
        "size": (r"^\d{1,3}B$",), "size_any_case": (r"^RXYN\d+B$", r"^FX[A-Z]{2}\d+B$"),
    },
    "toshiba": {
        "model": (),
        "model_any_case": (
            r"^RAV-GM\d", r"^RAV-[A-Z]{2}\d", r"^MAP\d", r"^SUG\d", r"^MUP\d", r"^UP\d{3,4}", r"^RBM-[A-Z]\d",
            r"^VN-U\d", r"^TCB-", r"^RTD-", r"^TAW-", r"^WDC\d", r"^RAS-B?\d{2}",
        ),
        "size": (), "size_any_case": (),
    },
    "mitsubishi": {
        "model": (r"^P[A-Z]{3}-",),
        "model_any_case": (
            r"^PEFY-[A-Z]\d", r"^PFFY-[A-Z]\d", r"^PLFY-[A-Z]\d", r"^PKFY-[A-Z]\d", r"^PCFY-[A-Z]\d", r"^PMFY-[A-Z]\d",
            r"^PUHY-", r"^PUMY-", r"^PURY-", r"^PQHY-", r"^PQRY-",
            r"^PCA-[A-Z]\d", r"^PEAD-[A-Z]\d", r"^PKA-[A-Z]\d", r"^PLA-[A-Z]\d", r"^PUZ-[A-Z]\d",
            r"^MSZ-[A-Z]{2}\d", r"^MXZ-\d", r"^MLZ-[A-Z]{2}\d",
            r"^SEZ-[A-Z]\d", r"^SFZ-[A-Z]\d", r"^SLZ-[A-Z]\d", r"^SUZ-", r"^PUHZ-",
            r"^CMB-[A-Z]\d", r"^CMH-", r"^MMD-",
        ),
        "size": (), "size_any_case": (),
    },
    "midea": {
        "model": (),
        "model_any_case": (
            r"^MDV-V\d", r"^MV8?-\d", r"^MIH?\d", r"^MCA\d", r"^MCD\d", r"^MCY-", r"^MTI[U]?-\d", r"^MTJ-\d", r"^MUE[U]?-\d",
            r"^MFA\d", r"^MFM-\d", r"^MSAG[A-Z]*-", r"^MSCB\d", r"^MSEP[A-Z]*-", r"^MSFA[A-Z]*-",
            r"^MEHP-", r"^RSJ-\d", r"^MHA-", r"^MHC-", r"^MHS-", r"^MSC-\d", r"^GK-\d", r"^GUF-\d", r"^EZ-\d", r"^EA-",
        ),
        "size": (), "size_any_case": (),
    },
}

# Node types by the beginning of a model code; the first that fits counts. Fixed values.
NODE_TYPES = (
    (r"^RPI[LH]?-", "indoor_unit"), (r"^RPK-", "indoor_unit"), (r"^RPC-", "indoor_unit"), (r"^RPF[I]?-", "indoor_unit"),
    (r"^RCI[M]?-", "indoor_unit"), (r"^RCD-", "indoor_unit"), (r"^RNC-", "indoor_unit"),
    (r"^RAS-\d", "outdoor_unit"), (r"^RASM-", "outdoor_unit"),
    (r"^RAK-", "indoor_unit"), (r"^RAC-", "outdoor_unit"), (r"^RAM-", "outdoor_unit"), (r"^RAD-", "indoor_unit"),
    (r"^RAF-", "indoor_unit"), (r"^RAI-", "indoor_unit"),
    (r"^RWM-", "outdoor_unit"), (r"^RWD-", "outdoor_unit"), (r"^RWH-", "outdoor_unit"), (r"^RWLT-", "outdoor_unit"),
    (r"^HWM-", "outdoor_unit"), (r"^HWD-", "outdoor_unit"), (r"^DHWT-", "tank"),
    (r"^KPI-", "outdoor_unit"), (r"^RCME-", "outdoor_unit"), (r"^PC-AR", "control"),
    (r"^ATW-", "accessory"), (r"^SPX-", "accessory"), (r"^CH-AP", "accessory"),
    (r"^FTXM", "indoor_unit"), (r"^FXMQ", "indoor_unit"), (r"^RXM", "outdoor_unit"), (r"^RXPA", "outdoor_unit"), (r"^ERQ", "outdoor_unit"),
    (r"^RAS-B", "indoor_unit"), (r"^RAS-M\d", "outdoor_unit"), (r"^MMK-", "indoor_unit"), (r"^MMY-", "outdoor_unit"), (r"^MMP-", "outdoor_unit"),
    (r"^MSZ-", "indoor_unit"), (r"^MUZ-", "outdoor_unit"), (r"^PUMY-", "outdoor_unit"), (r"^PEFY-", "indoor_unit"),
    (r"^PFFY-", "indoor_unit"), (r"^PLFY-", "indoor_unit"),
    (r"^M[ADST]-", "outdoor_unit"),
)
