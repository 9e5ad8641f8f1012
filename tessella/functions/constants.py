"""Fixed values of the clinical operators: thresholds, ranges, aliases. All are data; no logic lives here."""

from __future__ import annotations

# Shares of observed values from which a statistic is trusted.
TRUST = [(0.70, "high"), (0.40, "medium"), (0.20, "low")]
TRUST_ELSE = "very low"

# Noise sigma, lowest and highest value of a filled-in cell.
NOISE = {
    "bachcau": (0.3, 0.5, 50.0),
    "wbc": (0.3, 0.5, 50.0),
    "tieucau": (15.0, 5.0, 800.0),
    "plt": (15.0, 5.0, 800.0),
    "hct": (1.5, 15.0, 70.0),
    "hflc": (1.0, 0.0, 30.0),
    "phantramhflc": (1.0, 0.0, 30.0),
    "ast": (5.0, 0.0, 5000.0),
    "alt": (5.0, 0.0, 5000.0),
    "creatinin": (0.05, 0.1, 15.0),
}

# Reference ranges.
RANGES = {
    "WBC": "4-10 K/uL",
    "RBC": "3.8-5.5 M/uL",
    "HGB": "11-17 g/dL",
    "HCT": "35-50 %",
    "PLT": "150-400 K/uL",
    "AST": "0-25 U/L",
    "ALT": "0-25 U/L",
    "Na": "133-143 mmol/L",
    "K": "3.5-5.0 mmol/L",
    "Cl": "98-106 mmol/L",
    "Creatinine": "27-62 umol/L",
}

# Names of laboratory tests as reports spell them; the first test whose alias stands in a line wins.
EXAMS = {
    "WBC": ["wbc", "bc", "bạch cầu", "bach cau"],
    "RBC": ["rbc", "hồng cầu", "hong cau"],
    "HGB": ["hgb", "hb"],
    "HCT": ["hct", "hematocrit", "dthc"],
    "PLT": ["plt", "tiểu cầu", "tieu cau", "tc"],
    "AST": ["ast", "ast(got)", "got"],
    "ALT": ["alt", "alt(gpt)", "gpt"],
    "Na": ["na"],
    "K": ["k"],
    "Cl": ["cl"],
    "Creatinine": ["creatinin", "creatinine"],
    "CrCl": ["crcl"],
    "HFLC": ["hflc"],
    "NS1": ["dengue ns1ag", "ns1ag", "ns1"],
    "IgM": ["dengue igm", "igm"],
    "IgG": ["dengue igg", "igg"],
}

# Measures and symptoms as questions name them.
MEASURES = {
    "bạch cầu": "bachcau",
    "bach cau": "bachcau",
    "bachcau": "bachcau",
    "tiểu cầu": "tieucau",
    "tieu cau": "tieucau",
    "tieucau": "tieucau",
    "hflc": "HFLC",
    "%hflc": "phantramHFLC",
    "phần trăm hflc": "phantramHFLC",
    "phan tram hflc": "phantramHFLC",
    "hct": "Hct",
    "hematocrit": "Hct",
    "độ tuổi": "Tuoi",
    "do tuoi": "Tuoi",
    "tuổi": "Tuoi",
    "tuoi": "Tuoi",
}

# Spellings of one thing in multi-valued cells.
CANONICAL = {
    "petechiae": "petechia",
    "amdao": "am dao",
    "xhamdao": "am dao",
    "chaymaumui": "chay mau mui",
    "mui": "chay mau mui",
    "bammauvetchich": "vet chich",
    "vetchich": "vet chich",
    "chan rang": "chay mau rang",
    "chanrang": "chay mau rang",
    "chaymaurang": "chay mau rang",
    "tha": "tang huyet ap",
    "tăng huyết áp": "tang huyet ap",
    "tanghuyetap": "tang huyet ap",
    "dtd": "dai thao duong",
    "đái tháo đường": "dai thao duong",
    "daithaoduong": "dai thao duong",
}

# Rank fusion, reranking and diversity.
RRF_K, CANDIDATES = 60, 30
KEEP, CHUNK_SIMILARITY, SENTENCES, SENTENCE_SIMILARITY, LAMBDA, CARDS, CARD_CHARS = 6, 0.35, 4, 0.30, 0.7, 3, 350
BM25_K1, BM25_B = 1.5, 0.75

# Synonyms added to a query, by canonical term.
SYNONYMS = {
    "tiểu cầu": ["tieu cau", "plt", "platelet", "platelets"],
    "hematocrit": ["hct", "ht", "ti le hct", "tỉ lệ hct"],
    "bạch cầu": ["bach cau", "wbc", "leukocyte"],
    "men gan": ["ast", "alt", "sgot", "sgpt", "transaminase"],
    "albumin": ["alb", "đạm máu"],
    "creatinin": ["creat", "creatinine"],
    "sốt xuất huyết": ["sxhd", "sxh", "dengue", "df", "dhf"],
    "dấu hiệu cảnh báo": ["warning sign", "canh bao", "cảnh báo"],
    "sốc": ["soc", "shock", "dss", "dengue shock"],
    "xuất huyết nặng": ["xh nặng", "xuất huyết tiêu hóa", "xhth", "severe bleeding"],
    "đau bụng": ["dau bung", "abdominal pain", "đau vùng gan"],
    "nôn": ["non", "non oi", "nôn ói", "vomit", "vomiting"],
    "gan to": ["gan lon", "hepatomegaly", "to gan"],
    "tay chân lạnh": ["chi lanh", "cold extremities", "ngoại biên lạnh"],
    "tràn dịch": ["tran dich", "effusion", "tdmp", "tdmb"],
    "lừ đừ": ["lu du", "vật vã", "lethargy", "rối loạn ý thức", "li bì"],
    "paracetamol": ["pcm", "acetaminophen", "hạ sốt"],
    "aspirin": ["asa", "acetylsalicylic"],
    "ibuprofen": ["ibu", "nsaid", "nsaids"],
    "analgin": ["metamizole", "dipyrone"],
    "bù dịch": ["bu dich", "fluid resuscitation", "truyền dịch", "ringer", "lactat", "nacl 0.9"],
    "cao phân tử": ["cpt", "colloid", "dextran", "haes", "hydroxyethyl"],
    "ngày bệnh": ["ngay benh", "n1", "n2", "n3", "n4", "n5", "n6", "n7", "fever day"],
    "giai đoạn nguy hiểm": ["critical phase", "n4-n6", "hết sốt"],
    "giai đoạn hồi phục": ["recovery", "tái hấp thu"],
}

# What a line holds that tells of laboratory results.
LAB_WORDS = [
    "wbc", "rbc", "hgb", "hb", "hct", "plt", "ast", "alt", "got", "gpt", "bạch cầu", "bach cau", "hồng cầu", "hong cau", "tiểu cầu", "tieu cau",
    "hematocrit", "creatinin", "creatinine", "natri", "kali", "clo", "glucose", "ure", "albumin", "ferritin", "ldh", "crp", "inr", "aptt", "ns1", "igm", "igg", "hflc",
]

# Parts of notes on a patient's state that make it severe, and that make it one to watch.
SEVERE_NOTES = ["soc", "sxhnang", "sox", "xuathuyet", "tonthuong", "xhthtren", "shh", "gan", "than"]
WATCHED_NOTES = ["canhbao", "tieuhuyetsacto", "thai"]

# Accented letters and what folding makes of them (the d with stroke stays as it is).
ACCENTED = "áàảãạăắằẳẵặâấầẩẫậéèẻẽẹêếềểễệíìỉĩịóòỏõọôốồổỗộơớờởỡợúùủũụưứừửữựýỳỷỹỵçñäëïöüî"
PLAIN = "aaaaaaaaaaaaaaaaaeeeeeeeeeeeiiiiiooooooooooooooooouuuuuuuuuuuyyyyycnaeioui"

# Characters that scanning takes for digits.
SCANNED, DIGITS = "OolISBZg", "00115829"

# Ordinal labels.
ORDER = {"common": 1, "warning": 2, "severe": 3}

# Targets of a deployable model.
DEPLOY = {"critical": 0, "under": 0.10, "severe_recall": 0.90}

# Requests for a prescription. All question patterns are held against lower-case text.
PRESCRIPTION = [
    r"(?:^|[^\p{L}\p{N}_])kê\s*đơn(?:$|[^\p{L}\p{N}_])",
    r"(?:^|[^\p{L}\p{N}_])nên\s*uống\s*thuốc\s*gì",
    r"(?:^|[^\p{L}\p{N}_])(?:bao\s*nhiêu|mấy)\s+(?:viên|mg|ml|lần|giọt|gói)",
    r"(?s)(?:^|[^\p{L}\p{N}_])liều(?:$|[^\p{L}\p{N}_]).{0,40}(?:bao\s*nhiêu|cụ\s*thể|chính\s*xác|\d+\s*mg|\d+\s*ml)",
    r"(?:^|[^\p{L}\p{N}_])cho\s*tôi\s*đơn\s*thuốc",
]
# Hints that a question is about one patient, and that it is about general knowledge.
PATIENT = [
    r"(?:^|[^\p{L}\p{N}_])(?:bệnh\s*nhân|bn(?:$|[^\p{L}\p{N}_])|case(?:$|[^\p{L}\p{N}_])|ca\s*này|bé|cô|chú|ông|bà)",
    r"(?:^|[^\p{L}\p{N}_])(?:của|cho)\s+(?:tôi|mình|bạn\s*này|em)",
    r"(?:^|[^\p{L}\p{N}_])plt\s*[=:]\s*\d",
    r"(?:^|[^\p{L}\p{N}_])hct\s*[=:]\s*\d",
    r"(?:^|[^\p{L}\p{N}_])n[1-9](?:$|[^\p{L}\p{N}_]).*\d",
    r"(?:^|[^\p{L}\p{N}_])(?:đang|hiện)\s+(?:sốt|đau|nôn)",
]
GENERAL = [
    r"(?:^|[^\p{L}\p{N}_])(?:định nghĩa|là gì|khái niệm|phân loại)(?:$|[^\p{L}\p{N}_])",
    r"(?:^|[^\p{L}\p{N}_])(?:nguyên\s*tắc|hướng\s*dẫn|guideline|phác\s*đồ)(?:$|[^\p{L}\p{N}_])",
    r"(?:^|[^\p{L}\p{N}_])(?:khi nào|bao giờ)\s+(?:cần|nên|phải)(?:$|[^\p{L}\p{N}_])",
]

# Groups of severity as questions name them (the first that is met counts), and as records spell them.
SEVERITIES = {
    "sốc": "sốc / nặng",
    "soc": "sốc / nặng",
    "nặng": "sốc / nặng",
    "cảnh báo": "cảnh báo sốt xuất huyết",
    "canh bao": "cảnh báo sốt xuất huyết",
    "sxh": "sốt xuất huyết",
}
HISTORY = ["tiền căn sxh", "tien can sxh"]
# Symptoms as questions name them.
SYMPTOMS = {
    "nôn ói": "NVnonoi", "non oi": "NVnonoi", "nonoi": "NVnonoi",
    "tiêu chảy": "NVtieuchay", "tieu chay": "NVtieuchay", "tieuchay": "NVtieuchay",
    "đau bụng": "NVdaubung", "dau bung": "NVdaubung", "daubung": "NVdaubung",
    "đau cơ": "NVdauco", "dau co": "NVdauco", "dauco": "NVdauco",
    "đau đầu": "NVdaudau", "dau dau": "NVdaudau", "daudau": "NVdaudau",
    "đau sau hốc mắt": "NVdausauhocmat", "dau sau hoc mat": "NVdausauhocmat", "dausauhocmat": "NVdausauhocmat",
    "ho": "NVho",
    "xuất huyết": "NVxuathuyet", "xuat huyet": "NVxuathuyet",
    "gan to": "NVganto", "gan lớn": "NVganto",
    "petechia": "Petechia", "ban xuat huyet": "Petechia",
}
# Phrases that an intent goes by, in the order in which intents are tried; the third kind takes two of its lists.
BLEEDING = ["vị trí xuất huyết", "vi tri xuat huyet", "xuất huyết ở vị trí nào", "xuat huyet o vi tri nao", "chảy máu ở vị trí nào", "chay mau o vi tri nao"]
OTHER_SYMPTOMS = ["triệu chứng khác", "trieu chung khac", "các triệu chứng khác", "cac trieu chung khac"]
SYMPTOM_WORDS = [
    "nôn ói", "non oi", "nonoi", "tiêu chảy", "tieu chay", "tieuchay", "đau bụng", "dau bung", "daubung", "đau cơ", "dau co", "dauco",
    "đau đầu", "dau dau", "daudau", "đau sau hốc mắt", "dau sau hoc mat", "dausauhocmat", "ho", "triệu chứng", "trieu chung", "xuất huyết", "xuat huyet",
]
COHORT_WORDS = ["ở bệnh nhân", "o benh nhan", "ở nhóm", "o nhom", "giới tính", "gioi tinh", "nữ", " nam ", "tiền căn sxh", "tien can sxh"]
INTENTS = {
    "history_stats": ["tiền căn sxh", "tien can sxh"],
    "gender_stats": ["giới tính", "gioi tinh", "nam nữ", "nam nu"],
    "age_stats": ["độ tuổi", "do tuoi", "tuổi trung bình", "tuoi trung binh"],
    "top_comorbidity": ["bệnh lý nền", "benh ly nen", "comorbidity"],
    "compare_query": ["so sánh", "so sanh"],
}
OVERVIEW = ["có bao nhiêu bệnh nhân", "co bao nhieu benh nhan", "tổng số bệnh nhân", "tong so benh nhan", "bao nhiêu ca", "bao nhieu ca"]

# A page named in an answer, and a number that stands with the name of a test.
CITATION = r"(?i)(trang|tr\.|p\.|page)\s*\d{1,4}"
LAB_NUMBER = r"(?i)\b(plt|tiểu cầu|tieu cau|hct|hematocrit|wbc|bạch cầu|bach cau|ast|alt|sgot|sgpt|creatinin|alb)\b\s*[:=]?\s*[\d.]+"
# What named parts of a document begin with, and lines that its pages repeat.
PARTS = ["phụ lục", "phần", "chương"]
PAGE_LINES = ["TRUYỀN NHIỄM", "Truyền nhiễm"]

# Clinical signs that the severity rules take as warnings and as red flags.
WARNING_SIGNS = ["abdominal_pain", "vomiting_many", "mucosal_bleeding", "oliguria", "lethargy"]
RED_SIGNS = ["cold_extremities", "dyspnea", "hypotension", "severe_bleeding"]
MINOR_SIGNS = ["myalgia", "retro_orbital_pain"]
# Signs of a form and the graph's nodes for them.
SIGN_NODES = {
    "fever_now": "sot_cao", "abdominal_pain": "dau_bung_nhieu", "vomiting": "non_nhieu", "vomiting_many": "non_nhieu",
    "mucosal_bleeding": "chay_mau_niem_mac", "oliguria": "tieu_it", "lethargy": "lu_du_vat_va", "cold_extremities": "tay_chan_lanh",
    "myalgia": "dau_co_khop", "retro_orbital_pain": "dau_hoc_mat", "dyspnea": "tran_dich", "petechia": "ban_xuat_huyet", "headache": "dau_dau",
}
# What a kind of concept says of the grades of severity: relation, grades, weight; by concept where it differs.
RELATIONS = {
    "symptom": [("supports", "sxhd_thuong", 1.0)],
    "warning_sign": [("warning_of", "sxhd_canh_bao", 1.0)],
    "lab": [("supports", "sxhd_canh_bao", 1.0)],
    "contraindicated": [("contraindicated_for", g, 1.0) for g in ("sxhd_thuong", "sxhd_canh_bao", "sxhd_nang")],
    "drug": [("treats", g, 1.0) for g in ("sxhd_thuong", "sxhd_canh_bao")],
}
MILD_LABS = ["hflc_cao", "bach_cau_thap"]
SEVERE_WARNINGS = ["tay_chan_lanh", "lu_du_vat_va", "hct_tang_plt_giam"]
# Names of columns as people read them.
MEASURE_NAMES = {"bachcau": "bạch cầu", "tieucau": "tiểu cầu", "HFLC": "HFLC", "phantramHFLC": "%HFLC", "Hct": "Hct", "Tuoi": "tuổi"}
SYMPTOM_NAMES = {
    "NVnonoi": "nôn ói", "NVtieuchay": "tiêu chảy", "NVdaubung": "đau bụng", "NVdauco": "đau cơ", "NVdaudau": "đau đầu",
    "NVdausauhocmat": "đau sau hốc mắt", "NVho": "ho", "NVxuathuyet": "xuất huyết", "NVganto": "gan to", "Petechia": "ban xuất huyết dạng chấm",
}
TOKEN_NAMES = {
    "petechia": "ban xuất huyết dạng chấm (petechia)", "am dao": "âm đạo", "chay mau mui": "chảy máu mũi",
    "vet chich": "vết chích / bầm máu tại vết chích", "chay mau rang": "chảy máu chân răng", "tang huyet ap": "tăng huyết áp", "dai thao duong": "đái tháo đường",
}
