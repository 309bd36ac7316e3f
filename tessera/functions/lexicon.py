"""Word lists and constants that define the text operators. They are data, kept in one place so that they can be swapped."""

from __future__ import annotations

# These lists, in their natural order, decide results.

STOP_WORDS = tuple(
    """
    the and or but in on at to for of with by is are was were be been have has had do does did will would could should
    may might can must a an this that these those i you he she it we they
    patient report noted showed appears seems suggests indicates consistent compatible unremarkable within normal limits
    stable unchanged compared prior study exam examination findings impression conclusion recommendation discussed
    reviewed evaluated assessed documented
    today yesterday tomorrow now then currently recently previously following during after before
    """.split()
)

MODEL_STOP_WORDS = tuple(
    """
    the and or but in on at to for of with by is are was were be been have has had do does did will would could should
    may might can must a an this that these those i you he she it we they
    """.split()
)

ABBREVIATIONS = {
    "g": "gravida",
    "p": "para",
    "ab": "abortion",
    "lmp": "last menstrual period",
    "edd": "expected delivery date",
    "ga": "gestational age",
    "fhr": "fetal heart rate",
    "bpp": "biophysical profile",
    "nst": "non stress test",
    "cst": "contraction stress test",
    "gtt": "glucose tolerance test",
    "gbs": "group b streptococcus",
    "bp": "blood pressure",
    "hr": "heart rate",
    "rr": "respiratory rate",
    "temp": "temperature",
    "wt": "weight",
    "ht": "height",
    "bmi": "body mass index",
    "hx": "history",
    "px": "physical exam",
    "dx": "diagnosis",
    "tx": "treatment",
    "rx": "prescription",
    "sx": "symptoms",
    "fx": "fracture",
    "ca": "cancer",
    "hgb": "hemoglobin",
    "hct": "hematocrit",
    "wbc": "white blood cells",
    "rbc": "red blood cells",
    "plt": "platelets",
    "bun": "blood urea nitrogen",
    "cr": "creatinine",
    "gfr": "glomerular filtration rate",
    "alt": "alanine transaminase",
    "ast": "aspartate transaminase",
    "ldh": "lactate dehydrogenase",
    "mg": "milligrams",
    "mcg": "micrograms",
    "ml": "milliliters",
    "cc": "cubic centimeters",
    "mm": "millimeters",
    "cm": "centimeters",
    "kg": "kilograms",
    "lbs": "pounds",
    "bpm": "beats per minute",
    "sob": "shortness of breath",
    "doe": "dyspnea on exertion",
    "cp": "chest pain",
    "n/v": "nausea and vomiting",
    "urti": "upper respiratory tract infection",
    "uti": "urinary tract infection",
    "dvt": "deep vein thrombosis",
    "pe": "pulmonary embolism",
    "mi": "myocardial infarction",
    "cva": "cerebrovascular accident",
}

CLINICAL_KEYWORDS = tuple(
    """
    preeclampsia gestational_diabetes placenta_previa placental_abruption hyperemesis_gravidarum oligohydramnios
    polyhydramnios intrauterine_growth_restriction preterm_labor cervical_insufficiency ectopic_pregnancy miscarriage
    bleeding cramping contractions nausea vomiting headache blurred_vision swelling weight_gain decreased_fetal_movement
    blood_pressure fundal_height fetal_heart_rate cervical_length amniotic_fluid estimated_fetal_weight biophysical_profile
    bed_rest medication monitoring delivery cesarean induction epidural magnesium_sulfate corticosteroids antibiotics
    """.split()
)

MODEL_KEYWORDS = tuple(
    """
    pregnancy prenatal gestational fetal maternal ultrasound trimester delivery labor contractions
    hypertension diabetes preeclampsia bleeding pain weight growth heartbeat movement position
    """.split()
)

MEDICATION_WORDS = ("prescribed", "taking", "medication", "drug", "rx")
SYMPTOM_WORDS = ("pain", "bleeding", "nausea", "vomiting", "headache", "cramping", "swelling", "dizziness", "fatigue", "shortness", "breath")
VITAL_WORDS = ("bp", "blood")

#: Sample sentences and their labels (1 is high risk).
SAMPLE_TEXTS = (
    ("Patient reports feeling well, no complaints of nausea or vomiting", 0),
    ("Experiencing severe morning sickness, unable to keep food down", 1),
    ("Blood pressure elevated at 150/95, protein in urine detected", 1),
    ("Routine prenatal visit, all vitals within normal limits", 0),
    ("Headaches and blurred vision reported, concerning for preeclampsia", 1),
    ("Fetal movement decreased, patient concerned about baby's wellbeing", 1),
    ("Gestational diabetes diagnosed, dietary counseling provided", 1),
    ("Normal pregnancy progression, patient feeling well", 0),
    ("Bleeding episodes reported, bed rest recommended", 1),
    ("Contractions starting, possible preterm labor", 1),
)
SAMPLE_INPUT_TEXT = "Patient feeling well today, no complaints. Blood pressure normal, fetal movement good."

#: Tabular layout: column and the range its sampler draws from.
TABULAR_RANGES = {
    "age": (18.0, 45.0),
    "weight": (45.0, 120.0),
    "height": (1.5, 1.9),
    "systolic": (90.0, 180.0),
    "diastolic": (60.0, 120.0),
    "glucose": (70.0, 180.0),
    "gestational_age": (10.0, 42.0),
    "hemoglobin": (8.0, 15.0),
    "pregnancies": (0.0, 5.0),
    "risk_factors": (0.0, 3.0),
}
SAMPLE_INPUT_ROW = (32.0, 65.0, 1.65, 125.0, 85.0, 95.0, 28.0, 12.0, 1.0, 0.0)
