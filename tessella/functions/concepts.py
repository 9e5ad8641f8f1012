"""The concepts of the guideline graph. Data only."""

from __future__ import annotations

# Concepts by type, in order: label, the patterns that find them (held against text in one line, whatever the case), and what
# else is known of them.
CONCEPTS = {
    "severity": {
        "sxhd_thuong": {"label": "SXHD thông thường", "patterns": [r"sxhd\s*thông\s*thường", r"dengue\s*thông\s*thường", r"không\s*có\s*dấu\s*hiệu\s*cảnh\s*báo"], "description": "Sốt + ≥2 dấu hiệu (đau đầu, đau cơ-khớp, đau hốc mắt, ban xuất huyết). Chưa có cảnh báo."},
        "sxhd_canh_bao": {"label": "SXHD có dấu hiệu cảnh báo", "patterns": [r"sxhd\s*có\s*dấu\s*hiệu\s*cảnh\s*báo", r"dengue\s*có\s*dấu\s*hiệu\s*cảnh\s*báo", r"có\s*dấu\s*hiệu\s*cảnh\s*báo"], "description": "Có ≥1 warning sign — cần nhập viện theo dõi sát."},
        "sxhd_nang": {"label": "SXHD nặng", "patterns": [r"sxhd\s*nặng", r"dengue\s*nặng", r"sốc\s*sxhd", r"sốc\s*sốt\s*xuất\s*huyết"], "description": "Sốc, xuất huyết nặng, hoặc suy đa cơ quan."},
    },
    "symptom": {
        "sot_cao": {"label": "Sốt cao đột ngột", "patterns": [r"sốt\s*cao", r"sốt\s*đột\s*ngột"]},
        "dau_dau": {"label": "Đau đầu", "patterns": [r"đau\s*đầu", r"nhức\s*đầu"]},
        "dau_co_khop": {"label": "Đau cơ / đau khớp", "patterns": [r"đau\s*cơ", r"đau\s*khớp", r"nhức\s*mỏi"]},
        "dau_hoc_mat": {"label": "Đau sau hốc mắt", "patterns": [r"đau\s*(sau\s*)?hốc\s*mắt"]},
        "ban_xuat_huyet": {"label": "Ban xuất huyết / petechia", "patterns": [r"petechia", r"ban\s*xuất\s*huyết", r"chấm\s*xuất\s*huyết"]},
        "da_niem_sung_huyet": {"label": "Da niêm sung huyết", "patterns": [r"sung\s*huyết", r"da\s*niêm\s*sung\s*huyết"]},
    },
    "warning_sign": {
        "dau_bung_nhieu": {"label": "Đau bụng nhiều / liên tục", "patterns": [r"đau\s*bụng\s*(nhiều|liên\s*tục)", r"đau\s*bụng\s*vùng\s*gan"]},
        "non_nhieu": {"label": "Nôn nhiều", "patterns": [r"nôn\s*(ói\s*)?(nhiều|liên\s*tục)", r"nôn\s*≥\s*\d+\s*lần"]},
        "chay_mau_niem_mac": {"label": "Chảy máu niêm mạc", "patterns": [r"chảy\s*máu\s*niêm\s*mạc", r"chảy\s*máu\s*(mũi|chân\s*răng|nướu)", r"xuất\s*huyết\s*niêm\s*mạc"]},
        "gan_to": {"label": "Gan to >2cm", "patterns": [r"gan\s*to\s*>?\s*2\s*cm", r"gan\s*to\s*đau", r"gan\s*to"]},
        "lu_du_vat_va": {"label": "Lừ đừ / vật vã / rối loạn ý thức", "patterns": [r"lừ\s*đừ", r"vật\s*vã", r"rối\s*loạn\s*tri\s*giác", r"li\s*bì"]},
        "tieu_it": {"label": "Tiểu ít", "patterns": [r"tiểu\s*ít", r"thiểu\s*niệu", r"nước\s*tiểu\s*<\s*0[,.]5\s*ml"]},
        "tay_chan_lanh": {"label": "Tay chân lạnh", "patterns": [r"tay\s*chân\s*lạnh", r"chi\s*lạnh", r"da\s*lạnh\s*ẩm"]},
        "hct_tang_plt_giam": {"label": "Hct tăng kèm tiểu cầu giảm nhanh", "patterns": [r"hct\s*tăng.*tiểu\s*cầu\s*giảm", r"tiểu\s*cầu\s*giảm.*hct\s*tăng", r"hematocrit\s*tăng.*tiểu\s*cầu\s*giảm"]},
        "tran_dich": {"label": "Tràn dịch màng phổi / màng bụng", "patterns": [r"tràn\s*dịch\s*màng\s*phổi", r"tràn\s*dịch\s*màng\s*bụng", r"tràn\s*dịch\s*đa\s*màng"]},
    },
    "lab": {
        "tieu_cau_thap": {"label": "Tiểu cầu giảm", "patterns": [r"tiểu\s*cầu\s*<\s*100", r"tiểu\s*cầu\s*giảm", r"plt\s*<\s*100", r"thrombocytopenia"], "threshold": "PLT < 100 K/uL"},
        "hct_cao": {"label": "Hct tăng", "patterns": [r"hct\s*tăng\s*≥?\s*20\s*%?", r"hematocrit\s*tăng", r"cô\s*đặc\s*máu"], "threshold": "Hct tăng ≥20% so với baseline"},
        "ast_alt_cao": {"label": "Men gan tăng", "patterns": [r"ast\s*[/\\]?\s*alt\s*tăng", r"men\s*gan\s*tăng", r"ast\s*>\s*\d+", r"alt\s*>\s*\d+", r"tổn\s*thương\s*gan"], "threshold": "AST/ALT > 2× ULN"},
        "bach_cau_thap": {"label": "Bạch cầu giảm", "patterns": [r"bạch\s*cầu\s*giảm", r"leukopenia", r"wbc\s*<\s*\d+"], "threshold": "WBC < 5 K/uL"},
        "hflc_cao": {"label": "HFLC tăng", "patterns": [r"hflc", r"high.fluorescent.lymphocyte", r"lympho\s*hoạt\s*hóa"], "threshold": ">10% — đáp ứng miễn dịch hoạt hóa"},
    },
    "drug": {
        "aspirin": {"label": "Aspirin", "patterns": [r"aspirin", r"acetylsalicylic"], "contraindicated": True},
        "ibuprofen": {"label": "Ibuprofen", "patterns": [r"ibuprofen"], "contraindicated": True},
        "nsaid_other": {"label": "Các NSAID khác", "patterns": [r"\bnsaid", r"thuốc\s*kháng\s*viêm\s*không\s*steroid"], "contraindicated": True},
        "analgin": {"label": "Analgin / Metamizole", "patterns": [r"analgin", r"metamizole"], "contraindicated": True},
        "paracetamol": {"label": "Paracetamol", "patterns": [r"paracetamol", r"acetaminophen"], "contraindicated": False, "note": "Được phép — chỉ paracetamol đơn chất, đúng liều."},
    },
    "intervention": {
        "oresol": {"label": "Bù dịch đường uống (Oresol)", "patterns": [r"oresol", r"bù\s*nước\s*đường\s*uống", r"uống\s*nhiều\s*nước"], "treats": ["sxhd_thuong"]},
        "truyen_dich_tinh_mach": {"label": "Truyền dịch tĩnh mạch", "patterns": [r"truyền\s*dịch", r"ringer\s*lactate", r"nacl\s*0[,.]?9\s*%"], "treats": ["sxhd_canh_bao", "sxhd_nang"]},
        "nhap_vien_theo_doi": {"label": "Nhập viện theo dõi sát", "patterns": [r"nhập\s*viện", r"theo\s*dõi\s*sát"], "treats": ["sxhd_canh_bao"]},
        "hoi_suc_soc": {"label": "Hồi sức chống sốc", "patterns": [r"hồi\s*sức\s*sốc", r"chống\s*sốc", r"điều\s*trị\s*sốc"], "treats": ["sxhd_nang"]},
        "theo_doi_ngoai_tru": {"label": "Theo dõi tại nhà / ngoại trú", "patterns": [r"theo\s*dõi\s*tại\s*nhà", r"điều\s*trị\s*ngoại\s*trú", r"điều\s*trị\s*tại\s*nhà"], "treats": ["sxhd_thuong"]},
    },
}
