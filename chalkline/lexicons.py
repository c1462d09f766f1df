"""Word lists, lookup tables and message texts whose wording decides results."""

from __future__ import annotations

# ---- Fixed values of routing (substring tests on the lower-cased question)

CALCULATION_SIGNALS = (
    "hitung", "kira", "calculate", "find", "nilai", "berapa", "mol ", "mole", "jisim", "mass", "isipadu", "volume",
    "ph =", "poh", "delta h", "ΔH", "q =", "kalorimetri", "titration", "pentitratan", "stoikiometri", "nisbah mol",
    "nombor pengoksidaan", "oxidation number", "kadar tindak balas", "rate =", "pencairan", "dilution", "kemolaran",
)
THEORY_SIGNALS = (
    "terangkan", "explain", "takrifkan", "define", "apakah", "what is", "jelaskan", "describe", "bandingkan", "compare",
    "bezakan", "perbezaan", "difference", "mengapa", "why", "bagaimana", "how does", "senaraikan", "list",
    "kesan", "effect", "faktor", "factor", "ciri", "property",
)
QA_SIGNALS = ("soalan", "question", "jawab", "answer", "spm", "exam", "peperiksaan", "skema", "scheme", "marking")

QUERY_EXPANSIONS = {
    "mol": "mol mole bilangan mol",
    "jisim": "jisim mass jisim molar molar mass",
    "pH": "pH keasidan acid hydrogen ion",
    "pOH": "pOH alkalinity hydroxide ion",
    "kadar": "kadar tindak balas rate of reaction laju",
    "haba": "haba heat thermochemistry termokimia",
    "entalpi": "entalpi enthalpy ΔH perubahan haba",
    "redoks": "redoks redox pengoksidaan penurunan oxidation reduction",
    "titration": "pentitratan titration peneutralan",
    "polimer": "polimer polymer monomer pempolimeran polymerisation",
    "ikatan": "ikatan kimia chemical bond ion kovalen ionic covalent",
    "isotop": "isotop isotope jisim atom relatif",
}

# ---- Fixed values of language detection

MALAY_MARKERS = (
    "ialah", "adalah", "daripada", "kepada", "dengan", "untuk", "yang", "ini", "dalam", "bilangan", "jisim", "isipadu", "tindak balas",
    "kimia", "pengiraan", "hitungkan", "tentukan", "hitung", "langkah", "jawapan", "diberi",
)
ENGLISH_MARKERS = ("calculate", "find", "determine", "given", "solution", "answer", "formula", "reaction", "volume", "mass", "number", "step", "molar", "concentration")
ENGLISH_TOKENS = (
    "what", "why", "how", "explain", "calculate", "find", "determine", "define", "describe", "compare", "difference", "between", "state",
    "list", "give", "write", "draw", "show", "the", "is", "are", "of", "in", "and", "with", "from", "number", "moles", "mass", "volume",
    "concentration", "reaction", "acid", "base", "salt", "bond",
)

# ---- Fixed values of memory

PERSONAL_WORDS = (
    "tadi", "sebelum", "soalan saya", "yang saya tanya", "jawapan tadi", "maksud tadi", "itu tadi", "saya faham", "boleh ulang",
    "terangkan lagi", "lebih lanjut", "previous", "before", "just asked", "my question", "repeat", "explain more", "what you said",
    "earlier", "last question", "again",
)
#: language -> head, name of the user, name of the other side, foot
HISTORY_FRAMES = {
    "EN": ("\n\nPREVIOUS CONVERSATION:", "Student", "Assistant", "(Use above history if the new question refers to previous conversation)"),
    "BM": ("\n\nSEJARAH PERBUALAN SEBELUM INI:", "Pelajar", "Assistant", "(Gunakan sejarah di atas jika soalan baru berkaitan dengan perbualan sebelum ini)"),
}

# ---- Fixed values of index routing by content type and by task

CONTENT_INDEX = {
    "theory": "index_theory", "definition": "index_theory", "diagram": "index_theory", "calculation": "index_calculations", "formula": "index_calculations", "qa_scheme": "index_qa",
}
CALCULATION_TASKS = (
    "moles_from_mass", "moles_from_volume", "moles_multi", "mass_from_moles", "volume_from_moles", "mass_from_volume", "volume_from_mass",
    "particles_from_moles", "particles_from_mass", "particles_from_volume", "molarity_from_mass", "mass_from_molarity", "concentration_g_dm3",
    "dilution", "stoichiometry_mass_to_mass", "empirical_formula", "jmr", "calorimetry", "delta_h_from_calorimetry", "oxidation_number",
    "rate_average", "rate_from_points", "ar_from_abundance", "subatomic", "redox_change",
)
#: Other tasks, known or not, search calculations, then theory.

# ---- Fixed values of file names: key in the upper-cased stem -> (chapter, form, topic), first that fits

FILE_TOPICS = (
    ("BAB_1_PENGENALAN_KEPADA_KIMIA", 1, 4, "Pengenalan Kepada Kimia"),
    ("BAB_2_JIRIM_DAN_STRUKTUR_ATOM", 2, 4, "Jirim dan Struktur Atom"),
    ("BAB__3_KONSEP_MOL", 3, 4, "Konsep Mol, Formula & Persamaan Kimia"),
    ("BAB_3_KONSEP_MOL", 3, 4, "Konsep Mol, Formula & Persamaan Kimia"),
    ("BAB_4_JADUAL_BERKALA_UNSUR", 4, 4, "Jadual Berkala Unsur"),
    ("BAB_5_IKATAN_KIMIA", 5, 4, "Ikatan Kimia"),
    ("BAB_1_KESEIMBANGAN_REDOKS", 1, 5, "Keseimbangan dan Redoks"),
    ("BAB_2_SEBATIAN_KARBON", 2, 5, "Sebatian Karbon"),
    ("BAB_3_TERMOKIMIA", 3, 5, "Termokimia"),
    ("BAB_4_POLIMER", 4, 5, "Polimer"),
    ("BAB_5_KIMIA_KONSUMER", 5, 5, "Kimia Konsumer dan Industri"),
    ("BAB_6_ASID_BES_GARAM", 6, 5, "Asid, Bes & Garam"),
    ("BAB_7_KADAR_TINDAK_BALAS", 7, 5, "Kadar Tindak Balas"),
    ("BAB_8_BAHAN_BUATAN", 8, 5, "Bahan Buatan dalam Industri"),
    ("MOL_CALCULATIONS", 3, 4, "Konsep Mol"),
    ("ACID_CALCULATIONS", 6, 5, "Asid Bes Garam"),
    ("RATE_CALCULATIONS", 7, 5, "Kadar Tindak Balas"),
    ("TERMOKIMIA_CALCULATIONS", 3, 5, "Termokimia"),
    ("REDOX_CALCULATIONS", 1, 5, "Redoks"),
    ("JISIM_ATOM_RELATIF", 2, 4, "Jirim dan Struktur Atom"),
    ("MASTER_CALCULATION_REFERENCE", 0, 0, "Rujukan Formula"),
)

# ---- Fixed values of keyword synonyms, in order

SYNONYMS = {
    "mol": "mole", "jisim": "mass", "jisim molar": "molar mass", "jisim atom relatif": "relative atomic mass",
    "jisim molekul relatif": "relative molecular mass", "isipadu": "volume", "isi padu": "volume", "bilangan zarah": "number of particles",
    "bilangan mol": "number of moles", "nombor avogadro": "Avogadro's number", "kemolaran": "molarity", "kepekatan": "concentration",
    "asid": "acid", "bes": "base", "alkali": "alkali", "garam": "salt", "neutralisasi": "neutralisation", "pentitratan": "titration",
    "pengoksidaan": "oxidation", "penurunan": "reduction", "nombor pengoksidaan": "oxidation number", "kadar tindak balas": "rate of reaction",
    "tenaga pengaktifan": "activation energy", "mangkin": "catalyst", "haba": "heat", "entalpi": "enthalpy", "eksotermik": "exothermic",
    "endotermik": "endothermic", "termokimia": "thermochemistry", "polimer": "polymer", "monomer": "monomer", "pempolimeran": "polymerisation",
    "ikatan kimia": "chemical bond", "ikatan ion": "ionic bond", "ikatan kovalen": "covalent bond", "ikatan hidrogen": "hydrogen bond",
    "elektron valens": "valence electron", "susunan elektron": "electron configuration", "jadual berkala": "periodic table",
    "kumpulan": "group", "kala": "period", "unsur peralihan": "transition element", "gas adi": "noble gas",
    "formula empirik": "empirical formula", "formula molekul": "molecular formula", "persamaan kimia": "chemical equation",
    "stoikiometri": "stoichiometry", "alkana": "alkane", "alkena": "alkene", "alkuna": "alkyne", "alkohol": "alcohol",
    "asid karboksilik": "carboxylic acid", "ester": "ester", "getah": "rubber", "pemvulkanan": "vulcanisation", "pH": "pH", "pOH": "pOH",
    "ion hidrogen": "hydrogen ion", "ion hidroksida": "hydroxide ion", "isotop": "isotope", "nombor proton": "proton number",
    "nombor nukleon": "nucleon number", "elektrod": "electrode", "sel elektrolisis": "electrolysis cell", "sel galvani": "galvanic cell",
}

# ---- Fixed values of chemistry

ATOMIC_MASS = {
    "H": 1.0, "He": 4.0, "Li": 7.0, "Be": 9.0, "B": 11.0, "C": 12.0, "N": 14.0, "O": 16.0, "F": 19.0, "Ne": 20.0, "Na": 23.0, "Mg": 24.0,
    "Al": 27.0, "Si": 28.0, "P": 31.0, "S": 32.0, "Cl": 35.5, "Ar": 40.0, "K": 39.0, "Ca": 40.0, "Sc": 45.0, "Ti": 48.0, "Cr": 52.0,
    "Mn": 55.0, "Fe": 56.0, "Co": 59.0, "Ni": 59.0, "Cu": 63.5, "Zn": 65.0, "Ga": 70.0, "Ge": 73.0, "As": 75.0, "Se": 79.0, "Br": 80.0,
    "Kr": 84.0, "Ag": 108.0, "Sn": 119.0, "I": 127.0, "Ba": 137.0, "Pt": 195.0, "Au": 197.0, "Hg": 201.0, "Pb": 207.0,
}
AVOGADRO, MOLAR_VOLUME_ROOM, MOLAR_VOLUME_STANDARD, WATER_HEAT = 6.02e23, 24.0, 22.4, 4.2

# ---- Fixed values of recognition confidence

MALAY_CHEMISTRY = (
    "mol", "jisim", "isipadu", "kepekatan", "kemolaran", "hitungkan", "tentukan", "kira", "berapakah", "nyatakan", "ph", "poh", "entalpi",
    "enthalpi", "termokimia", "titrasi", "stoikiometri", "formula", "persamaan", "asid", "bes", "garam", "larutan", "tindak balas",
    "kadar", "pengoksidaan", "penurunan", "elektrod", "unsur", "sebatian", "ion", "elektron", "proton", "nombor oxidasi", "jmr", "ar",
)
ENGLISH_CHEMISTRY = (
    "mol", "mass", "volume", "concentration", "molarity", "calculate", "determine", "find", "what is", "state", "ph", "poh", "enthalpy",
    "thermochem", "titration", "stoichiometry", "formula", "equation", "acid", "base", "salt", "solution", "reaction", "rate",
    "oxidation", "reduction", "electrode", "element", "compound", "ion", "electron", "proton", "relative", "molar", "empirical",
)
STRUCTURE_MARKERS = ("SOALAN:", "PILIHAN:", "DATA_NOMBOR:", "FORMULA_KIMIA:", "PERSAMAAN_KIMIA:", "JENIS_PENGIRAAN:", "QUESTION:", "OPTIONS:")
CALCULATION_WORDS = ("hitungkan", "calculate", "berapakah", "find", "hitung", "tentukan", "determine", "nilai", "value")
KNOWN_ELEMENTS = (
    "H", "He", "Li", "Be", "B", "C", "N", "O", "F", "Ne", "Na", "Mg", "Al", "Si", "P", "S", "Cl", "Ar", "K", "Ca", "Sc", "Ti", "V", "Cr",
    "Mn", "Fe", "Co", "Ni", "Cu", "Zn", "Ga", "Ge", "As", "Se", "Br", "Kr", "Rb", "Sr", "Y", "Zr", "Nb", "Mo", "Ag", "Cd", "In", "Sn",
    "Sb", "Te", "I", "Xe", "Cs", "Ba", "La", "Ce", "Hf", "Ta", "W", "Re", "Os", "Ir", "Pt", "Au", "Hg", "Tl", "Pb", "Bi", "Po", "At",
    "Rn", "Fr", "Ra", "Ac", "Th", "U",
)
