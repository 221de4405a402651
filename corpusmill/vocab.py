"""Fixed values.

Word lists, patterns, formats and constants the results depend on. They are
kept together, as plain text and in their natural order, so that another
language can be swapped in by passing other lists to the operators.
"""

from __future__ import annotations

# --- fixed values: sentinels and defaults -----------------------------------
UNKNOWN = "Không xác định"
UNKNOWN_FORMS = ["không xác định", "khong xac dinh", "none", "null"]
META_DEFAULTS = {
    "doc_type": "Khác",
    "issuer": "Không xác định",
    "doc_number": "Không xác định",
    "date": None,
    "title": "Không xác định",
    "section": "khac",
    "topic": "khac",
}
SHEET_DOC_TYPE = "Danh_sách"

# --- fixed values: sizes ----------------------------------------------------
ROWS_PER_TABLE_CHUNK = 20
TABLE_MAX_CHARS = 1200
SPLIT_SIZE = 850
SPLIT_OVERLAP = 120
SPLIT_SEPARATORS = ["\nĐiều ", "\nKhoản ", "\nMục ", "\n\n", "\n", ". ", " ", ""]
MIN_TEXT_CHARS = 30
FIRST_PAGE_NATIVE_CHARS = 60
SEARCH_LIMIT = 20
CONTEXT_LIMIT = 15000
CONTEXT_PART_LIMIT = 2000
CONTEXT_CUT_MARK = "\n...[đã cắt bớt]"
CONTEXT_SEPARATOR = "\n\n---\n\n"
SCROLL_LIMIT = 50
EXPANSION_DOCS = 2
EXPANSION_PER_DOC = 10
EMBED_CHARS = 4000
POINT_ID_CHARS = 160
INGEST_VERSION = 2

# --- fixed values: OCR corrections, applied in this order -------------------
OCR_FIXES = [
    (r"\bKh6a\b", "Khóa"),
    (r"\bChuo['’]?ng\b", "Chương"),
    (r"\bchuong\b", "chương"),
    (r"\bTién\b", "Tiền"),
    (r"\bdién\b", "điện"),
    (r"\bnuóc\b", "nước"),
    (r"\buóng\b", "uống"),
    (r"\bTong cong\b", "Tổng cộng"),
    (r"\bNoi dung\b", "Nội dung"),
    (r"\bDai hoc\b", "Đại học"),
    (r"\?\s*Ngân", "- Ngân"),
    (r"\bcá nám\b", "cả năm"),
]
OCR_DIGIT_FIXES = [
    (r"(?<=\d)[oO](?=[1-9]\b)", "0"),
    (r"(?i)\bolf\b", "01"),
    (r"(?i)\b0l\b", "01"),
]
# Lower-case fragments without which no rule above applies.
OCR_FIX_STEMS = [
    "kh6a", "chuo", "tién", "dién", "nuóc", "uóng", "tong cong", "noi dung", "dai hoc", "ngân", "cá nám",
]
OCR_DIGIT_STEMS = r"[oO](?:[lL][fF]|(?<=\p{Nd}[oO])[1-9])|0[lL]"
TABLE_LINE_STARTS = ["STT", "Noi", "Nội", "Khóa", "Khoa"]

# --- fixed values: document metadata rules, first match wins ----------------
DOC_TYPE_RULES = [
    ("Thông_báo", "thông báo"),
    ("Quyết_định", "quyết định"),
    ("Công_văn", "công văn"),
    ("Kế_hoạch", "kế hoạch"),
    ("Báo_cáo", "báo cáo"),
    ("Danh_sách", "danh sách"),
]
TITLE_PATTERNS = [
    r"(THÔNG\s+BÁO[^\n]{0,200})",
    r"(QUYẾT\s+ĐỊNH[^\n]{0,200})",
    r"(CÔNG\s+VĂN[^\n]{0,200})",
]
NUMBER_PATTERNS = [
    r"Số\s*[:.]?\s*([0-9A-Za-z/\-\.]+)",
    r"số\s*[:.]?\s*([0-9A-Za-z/\-\.]+)",
]
ISSUER_PATTERNS = [
    r"(Trường\s+Đại\s+học\s+[^\n]{3,120})",
    r"(Bộ\s+[^\n]{3,120})",
]
DATE_YMD = r"\b(20\d{2})[-/](\d{1,2})[-/](\d{1,2})\b"
DATE_DMY = r"\b(\d{1,2})[-/](\d{1,2})[-/](20\d{2})\b"
DATE_WORDS = r"ngày\s*(\d{1,2})\s*tháng\s*(\d{1,2})\s*năm\s*(20\d{2})"

# --- fixed values: table headers --------------------------------------------
HEADER_ID_TOKENS = ["ma sinh vien", "msv", "ma sv"]
HEADER_NAME_TOKENS = ["ho ten", "ten sinh vien", "sinh vien"]
HEADER_CLASS_TOKEN = "lop"
GENERIC_HEADER_TOKENS = ["stt", "mã", "nội dung", "khóa", "học kỳ"]
SHEET_HEADER_TOKENS = ["stt", "mã sinh viên", "họ và tên"]
SUB_HEADER_TOKENS = ["điểm số", "lớp xếp loại"]
SHEET_CONTEXT_TITLE = "**THÔNG TIN CHUNG:**"
SHEET_LIST_TITLE = "**DANH SÁCH CHI TIẾT:**"
TABLE_TYPES = ["table_html_scan", "table_md_scan", "table_md"]

# --- fixed values: query intent, rules in order -----------------------------
INTENT_DOC_STRONG = [
    "nội dung của", "nội dung quyết định", "nội dung thông báo",
    "chi tiết quyết định", "chi tiết thông báo", "cho tôi xin văn bản",
    "cho tôi xem văn bản", "đọc quyết định",
]
INTENT_STUDENT = ["điểm của", "msv", "mã sinh viên", "xếp loại của", "kết quả học tập của"]
INTENT_SCORE = ["điểm rèn luyện", "điểm thi", "điểm của"]
INTENT_DOC = [
    "thông báo", "quyết định", "công văn", "văn bản", "kế hoạch",
    "nội dung", "cho biết về", "cho tôi biết về",
]
INTENT_SCHEDULE = ["khi nào", "bao giờ", "lịch", "deadline", "hạn", "thời gian", "ngày", "tháng"]
INTENT_REGULATION = [
    "quy định", "quy trình", "thủ tục", "cách", "làm sao",
    "hướng dẫn", "điều kiện", "yêu cầu",
]
INTENT_EXAM = ["phòng thi", "lịch thi", "toeic", "thi", "ca thi", "địa điểm thi"]

# --- fixed values: retrieval gate -------------------------------------------
GREETING_START = r"^(xin\s+chào|chào\b|hello\b|hi\b|hey\b)"
THANKS_START = r"^(cảm\s*ơn|thanks\b|thank you\b)"
SMALL_TALK = [
    "xin chào", "chào bạn", "chào", "hello", "hi", "hey",
    "bạn là ai", "cảm ơn", "thanks", "thank you", "tạm biệt", "bye",
    "bạn khỏe không", "có gì mới", "bạn tên gì", "ai tạo ra bạn",
    "bạn có thể làm gì", "bạn giúp gì được",
]
# Terms naming one institution are a parameter of the gate, not listed here.
DOMAIN_TERMS = [
    "trường", "đại học", "tài chính", "ngân hàng",
    "thông tin", "biết gì", "cho biết", "giới thiệu", "là gì", "như thế nào",
    "ở đâu", "khi nào", "bao nhiêu", "có những", "danh sách",
    "học phí", "quy định", "thủ tục", "lịch", "đăng ký",
    "miễn giảm", "học bổng", "hồ sơ", "thông báo", "chính sách",
    "điểm", "môn học", "tín chỉ", "khoa", "viện", "ngành", "chương trình",
    "học kỳ", "kỳ thi", "tốt nghiệp", "bằng", "chứng chỉ",
    "phòng", "văn phòng", "liên hệ", "địa chỉ", "email", "số điện thoại",
    "giảng viên", "sinh viên", "cán bộ", "nhân viên", "hiệu trưởng",
    "cơ sở", "ký túc xá", "thư viện", "phòng học", "sân", "câu lạc bộ",
]
FOLLOWUP_LONG = [
    "còn", "khác", "thì sao", "nữa không", "nữa", "thêm",
    "chi tiết", "rõ hơn", "cụ thể", "giải thích", "tại sao",
    "vậy sao", "bao giờ", "như nào",
]
FOLLOWUP_SHORT = ["vậy", "thế", "sao", "hả", "nhỉ", "đâu", "mấy", "gì", "ai", "nào"]
FOLLOWUP_STARTS = ["của ", "về ", "còn ", "cho "]
REWRITE_GREETINGS = [
    "xin chào", "chào bạn", "chào", "hello", "hi", "bạn là ai", "cảm ơn", "thanks", "hey",
]
REWRITE_CONTEXT_TERMS = [
    "chi tiết", "thêm", "rõ hơn", "ví dụ", "cụ thể", "giải thích", "còn gì", "nữa không",
]
PERSONAL_TERMS = [
    "điểm", "học kỳ", "kỳ", "hk1", "hk2", "hk3",
    "xếp loại", "bao nhiêu", "thì sao", "còn",
]
ROUTER_PERSONAL_TERMS = ["điểm", "kỳ", "xếp loại", "bao nhiêu", "thì sao", "còn"]
PRONOUNS = [
    "nó", "cái đó", "vấn đề đó", "cái này", "về nó", "về điều đó", "trích", "trích ra",
    "trích xuất", "chi tiết", "rõ hơn", "đọc cho tôi",
]

# --- fixed values: keyword extraction ---------------------------------------
UPPER_CLASS = "A-ZÀÁÂÃÈÉÊÌÍÒÓÔÕÙÚĂĐĨŨƠƯẠ-Ỹ"
LOWER_CLASS = "a-zàáâãèéêìíòóôõùúăđĩũơưạ-ỹ"
COMMON_WORDS = [
    "cho", "của", "và", "hoặc", "trong", "về", "với", "theo",
    "tôi", "bạn", "này", "đó", "các", "những", "một", "hai",
    "xin", "hãy", "nếu", "khi", "sau", "trước", "từ", "đến",
    "tại", "trên", "dưới", "là", "có", "được", "không", "đã",
    "sẽ", "đang", "rất", "nhiều", "ít", "thì", "mà", "để",
    "vì", "nên", "cũng", "còn", "lại", "ra", "vào", "lên",
    "xuống", "biết", "làm", "gì", "nào", "đâu", "sao", "thế",
    "như", "nữa", "đây", "kia", "ấy", "họ", "chúng",
    "điểm", "rèn", "luyện", "học", "kỳ", "sinh", "viên",
    "lớp", "khoa", "viện", "trường", "môn", "tín", "chỉ",
    "thông", "tin", "phí", "quy", "định", "hồ", "sơ",
    "thủ", "tục", "đăng", "ký", "năm", "kết", "quả",
    "danh", "sách", "bảng", "xếp", "loại", "giỏi", "khá",
    "trung", "bình", "yếu", "kém", "xuất", "sắc", "tốt",
]
DOMAIN_PHRASES = [
    "điểm rèn luyện", "công nhận", "quyết định", "thông báo",
    "học phí", "miễn giảm", "học bổng", "lịch thi", "tốt nghiệp",
]
SYNONYM_GROUPS = [
    ["học phí", "lệ phí", "tiền học", "thu tiền"],
    ["học phí", "lệ phí", "tiền học", "thu tiền"],
    ["nước uống", "tiền nước", "thu tiền nước"],
    ["nhập học", "tân sinh viên", "trúng tuyển"],
]
PERSON_HINTS = [
    "msv", "mã sinh viên", "sinh viên", "điểm của",
    "điểm rèn luyện", "điểm thi", "điểm rèn luyện của",
    "xếp loại của", "kết quả học tập của", "của",
]
PLACE_SPANS = ["Đại Học", "Tài Chính", "Ngân Hàng", "Hà Nội"]
NOT_NAME_WORDS = [
    "thông", "báo", "quyết", "định", "công", "văn", "nội", "dung",
    "điểm", "rèn", "luyện", "học", "phí", "bổng", "miễn",
    "giảm", "hồ", "sơ", "quy", "trình", "thủ", "tục", "nghỉ",
    "tết", "nguyên", "đán", "năm", "kỳ", "thời", "gian",
]
PERSON_SPAN = r"\b[A-ZÀ-Ỹ][\wÀ-ỹ]{1,6}(?:\s+[A-ZÀ-Ỹ][\wÀ-ỹ]{1,6}){1,4}\b"
PERSON_AFTER = (
    r"(?:của|hỏi về|về)\s+(?:sinh viên|bạn|bạn tên|người tên)?\s*"
    r"([\wÀ-ỹ]+(?:\s+[\wÀ-ỹ]+){1,4})"
)
PERSON_SUFFIX = r"\b(là|bao nhiêu|như thế nào|ra sao|học|tại)\b"

# --- fixed values: topics and ranking ---------------------------------------
TOPIC_TERMS = [
    "miễn giảm học phí", "miễn, giảm học phí", "miễn giảm", "học phí", "hồ sơ",
    "học bổng", "điểm rèn luyện", "lịch thi", "đổi lịch thi", "tết", "nguyên đán",
    "thu học phí", "lệ phí", "tốt nghiệp", "học kỳ",
]
STRICT_TOPICS = ["tết", "nguyên đán"]
TITLE_GROUPS = {
    "thu_hoc_phi": ["thu học phí", "thu phí", "lệ phí"],
    "mien_giam": ["miễn", "giảm học phí", "miễn, giảm"],
    "hoc_bong": ["học bổng", "cấp học bổng"],
    "diem_ren_luyen": ["điểm rèn luyện", "rèn luyện"],
    "lich_thi": ["lịch thi", "đổi lịch"],
    "tet": ["tết", "nguyên đán"],
    "tot_nghiep": ["tốt nghiệp"],
}
QUERY_GROUPS = [
    ("mien_giam", ["miễn giảm", "miễn, giảm", "giảm học phí", "đối tượng miễn", "hồ sơ miễn"]),
    ("thu_hoc_phi", ["học phí", "lệ phí", "thu phí", "phí kỳ", "phương thức nộp", "cách nộp", "tiền mặt"]),
    ("hoc_bong", ["học bổng", "thành tích"]),
    ("diem_ren_luyen", ["điểm rèn luyện", "rèn luyện"]),
    ("lich_thi", ["lịch thi", "ngày thi"]),
    ("tet", ["tết", "nguyên đán", "bính ngọ"]),
    ("tot_nghiep", ["tốt nghiệp"]),
]
SEMESTERS = [
    ("hk1", ["kỳ 1", "kỳ i", "hk1"]),
    ("hk2", ["kỳ 2", "kỳ ii", "hk2"]),
    ("hk3", ["kỳ 3", "kỳ phụ", "hk3"]),
]
YEAR = r"\b20\d{2}\b"
YEAR_RANGE = r"\b(20\d{2})\s*[-/]\s*(20\d{2})\b"
CONTEXT_LABELS = [
    ("title", "Văn bản"),
    ("doc_number", "Số"),
    ("date", "Ngày"),
    ("issuer", "Cơ quan"),
]
UNNAMED_SOURCE = "Tài liệu"
UNKNOWN_FILENAME = "Tài liệu không xác định"

# --- fixed values: answers --------------------------------------------------
CONTACT_BY_INTENT = {
    "document_info": "Phòng Hành chính - Tổng hợp",
    "schedule": "Phòng Đào tạo",
    "exam": "Phòng Khảo thí",
    "regulation": "Phòng Đào tạo",
    "student_lookup": "Phòng Công tác sinh viên",
}
CONTACT_DEFAULT = "phòng ban liên quan"
NO_DATA_LINES = [
    "Hiện chưa tìm thấy thông tin phù hợp trong hệ thống cho nội dung bạn hỏi.",
    "",
    "- Nội dung tra cứu: **{query}**",
    "- Gợi ý: thử thêm từ khóa như **thông báo**, **quyết định**, **số hiệu văn bản** hoặc **đơn vị ban hành**.",
    "- Nếu cần xác nhận chính thức, vui lòng liên hệ **{contact}** của trường.",
]
NO_DATA_OPENERS = [
    "hien chua tim thay thong tin",
    "khong tim thay thong tin",
    "chua tim thay thong tin",
]
SUBSTANTIVE_MARKERS = ["ngay ban hanh", "theo van ban", "dieu 1", "dieu 2", "noi dung chinh"]
NO_DATA_CHECKS = [
    "hien chua tim thay thong tin",
    "khong tim thay thong tin",
    "vui long lien he",
    "phong ban lien quan",
]
UNVERIFIED_NOTE = "\n\n⚠️ *Lưu ý: Một số thông tin có thể chưa được xác minh chính xác.*"
PLACEHOLDER_NOTE = (
    "*Bảng trong văn bản là biểu mẫu trống/placeholder nên mình không liệt kê từng dòng "
    "để tránh gây hiểu sai.*"
)
CUT_MARKERS = [
    "Trân trọng", "- Nơi nhận", "KT. BỘ TRƯỞNG", "KT. BO TRUONG", "THỨ TRƯỞNG", "THU TRUONG",
]
ROW_ID_NAME = r"\|\s*\d+\s*\|\s*(\d{10})\s*\|\s*([^|]+?)\s*\|"
ROW_RECORD = (
    r"\|\s*\d+\s*\|\s*(\d{10})\s*\|\s*([^|]+?)\s*\|\s*([^|]*?)\s*\|"
    r"\s*([^|]*?)\s*\|\s*(\d+)\s*\|\s*([^|]+?)\s*\|"
)
TERM_IN_CONTENT = r"(?:Đợt|đợt)\s*[:\s]*([HKhk]+\d)\s*[\(\[]?\s*(20\d{2}[-–]\d{2,4})"
TERM_IN_TITLE = r"(HK\d|Kỳ\s*[I1-9]+|học kỳ\s*\d)\s*[,\s]*(20\d{2}[-–]\d{2,4})"
TERM_UNKNOWN = "Không rõ kỳ"
MONEY = r"\d{1,3}(?:[\.,]\d{3})+"

# --- fixed values: rule-based answers ---------------------------------------
EXEMPT_ASK = ["la ai", "la gi", "doi tuong nao"]
EXEMPT_ITEM_1 = r"mien giam hoc phi.{0,400}phu luc 1"
EXEMPT_ITEM_2 = [r"81 2021.{0,300}phu luc 2", r"phu luc 2.{0,300}81 2021"]
EXEMPT_TITLE = "**Đối tượng sinh viên được miễn, giảm học phí gồm:**"
# {school} is a parameter.
EXEMPT_TEXT_1 = (
    "Đối tượng sinh viên được miễn, giảm học phí trực tiếp tại trường theo chính sách "
    "ưu đãi, hỗ trợ của {school} (theo phụ lục 1)."
)
EXEMPT_TEXT_2 = "Đối tượng được Nhà nước hỗ trợ đóng học phí theo Nghị định 81/2021/NĐ-CP (theo phụ lục 2)."
EXEMPT_TAIL = (
    "Nếu bạn cần, mình có thể liệt kê thêm **hồ sơ cụ thể** của từng nhóm theo Phụ lục 1 và Phụ lục 2."
)
FEE_WORDS = ["hoc phi", "le phi"]
FEE_SCOPES = ["ky 1", "ky i", "2025 2026", "thu le phi", "thu hoc phi"]
FEE_ANY_SEMESTER = ["thu hoc phi ky", "le phi hoc ky", "hoc phi ky", "thu le phi ky"]
FEE_FIRST = ["ky i", "ky 1"]
FEE_SECOND = ["ky ii", "ky 2"]
FEE_TITLE = "THÔNG BÁO Về việc thu học phí Kỳ I, năm học 2025-2026"
FEE_TRIPLE = r"([0-9][0-9\.,]{3,})\s*\|\s*([0-9][0-9\.,]{3,})\s*\|\s*([0-9][0-9\.,]{3,})"
FEE_TRIPLE_MARKERS = ["chuong trinh", "hoc phi", "dai hoc"]
FEE_ROW = r"\|\s*\d+\s*\|\s*([^|]+?)\s*\|\s*([0-9][0-9\.,]*\s*[dđ]?)\s*\|"
FEE_POWER = r"tien dien[^0-9]{0,80}([0-9][0-9\.,]*)\s*d?"
FEE_POWER_ITEM = "Tiền điện ĐHNĐ, tiền nước uống (cả năm)"
FEE_TOTAL = r"tong cong\s*([0-9 ]{3,})\s*d"
FEE_RATES = "**Mức học phí (đồng/tín chỉ):**"
FEE_RATE_LINES = ["- Khóa 11: **{}**", "- Khóa 12: **{}**", "- Khóa 13: **{}**"]
FEE_ITEMS = "**Các khoản lệ phí:**"
FEE_SUM = "- Tổng cộng: **{}**"
FEE_PORTAL = "**Cổng thanh toán:** {}"
FEE_METHODS = "**Phương thức nộp:**"
PAY_METHODS = [
    (["nop tien mat"], "Nộp tiền mặt tại Phòng Kế hoạch - Tài chính (Tầng 1, tòa nhà 31 Dịch Vọng Hậu)."),
    (["qr code"], "Nộp qua QR-Code động trên cổng sinh viên."),
    (["the atm noi dia", "may pos"], "Nộp qua thẻ ATM nội địa tại Phòng Kế hoạch - Tài chính (máy POS)."),
]
DIRECTIVE_ANCHOR = r"các công việc sau đây\s*[:.]"
DIRECTIVE_ITEM = r"(?m)(?<!\d)(\d{1,2})\s*[\.,]\s*(.+?)(?=(?:\n\s*\d{1,2}\s*[\.,]\s)|\z)"
DIRECTIVE_TITLE = "**Thông báo nghỉ Tết Nguyên đán 2026**"
HEADING_STOPS = ["noi nhan", "hieu truong", "doc lap tu do hanh phuc"]
HEADING_START = r"^(dieu|muc|phan|chuong|khoan)\s*[0-9ivxlc]+"
HEADING_TOKENS = [
    "doi tuong", "thoi gian", "dia diem", "ho so", "luu y",
    "muc thu", "hoc phi", "le phi", "phuong thuc", "dieu kien",
    "quyen loi", "nghia vu", "thoi han", "thanh phan",
]
SECTION_SKIPS = ["cong hoa xa hoi chu nghia", "doc lap tu do hanh phuc"]
ITEM_SKIPS = ["noi nhan", "hieu truong", "ky ten", "doc lap tu do hanh phuc"]
FOUR_SECTIONS = [
    ("Đối tượng và hồ sơ", ["doi tuong"], ["ho so", "mien giam hoc phi", "nop ho so"]),
    ("Thời gian nộp hồ sơ", ["thoi gian"], ["nop ho so", "nhan ho so", "han nop"]),
    ("Địa điểm nộp hồ sơ", ["dia diem"], ["nop ho so", "nhan ho so"]),
    ("Lưu ý", ["luu y", "han nop hoc phi"], [""]),
]
OUTLINE_STOPS = ["cho", "toi", "biet", "ve", "va", "la", "gi", "noi", "dung", "cua", "nam", "hoc", "ky"]
OUTLINE_FEE_ASKED = ["hoc phi", "le phi", "muc thu", "chi phi"]
OUTLINE_FEE_FOUND = ["hoc phi", "le phi", "muc thu"]
OUTLINE_TABLE_ASKED = ["hoc phi", "le phi", "muc thu", "so tien", "bang"]
OUTLINE_TUITION_TABLE = ["chuong trinh", "khoa 11", "tin chi", "muc thu hoc phi"]
OUTLINE_FEE_TABLE = ["le phi", "noi dung thu", "tong cong"]
OUTLINE_LEAD = "**Nội dung chính theo yêu cầu:** "
OUTLINE_TABLE = "**Bảng dữ liệu liên quan:**"
FILLER_COLUMN = "Cột "
ANSWER_ERRORS = ["xin loi", "su co ket noi", "khong tim thay thong tin"]
SAFE_QUERY_TERMS = [
    "nội dung", "quy định", "thông báo", "quyết định", "hồ sơ",
    "thủ tục", "miễn giảm", "học phí", "lịch",
]
SAFE_SOURCE = "Tài liệu scan (OCR)"
SAFE_YEAR = "Nội dung có nhắc tới năm học **{}**."
SAFE_FACTS = [
    (["mien giam hoc phi"], "Tài liệu đề cập hồ sơ **miễn, giảm học phí** cho sinh viên."),
    (["hoc ky ii", "hk ii", "hk2"], "Phạm vi áp dụng có nhắc tới **học kỳ II**."),
    (["giay khai sinh"], "Trong hồ sơ có nhắc tới **giấy khai sinh**."),
    (["ho ngheo", "can ngheo", "xac nhan"], "Có nhắc tới giấy tờ **xác nhận đối tượng/hộ nghèo-cận nghèo**."),
]
SAFE_DATES = "Mốc thời gian OCR đọc được: {}."
SAFE_NOTHING = "Bản OCR bị nhiễu mạnh, chưa đủ dữ liệu để trích xuất chính xác từng điều khoản."
SAFE_HEAD = "**Tài liệu liên quan:** {}"
SAFE_LEAD = "Dữ liệu OCR khá nhiễu nên mình chỉ nêu các ý chắc chắn đọc được:"
SAFE_TAIL = (
    "Nếu bạn cần độ chính xác cao theo từng điều/mục, mình sẽ trích nguyên văn từng đoạn OCR "
    "để bạn đối chiếu trực tiếp."
)
CLARIFY_HEAD = "Mình tìm thấy **{n} sinh viên** có tên chứa \"{name}\", bạn muốn hỏi về ai?\n"
CLARIFY_LINE = "- **{name}** — MSV: `{id}`"
CLARIFY_TAIL = "\nBạn hãy nhập **mã sinh viên** để mình tìm chính xác nhé!"
CLARIFY_NONE = "Mình không tìm thấy sinh viên nào tên **{name}** trong dữ liệu."
RECORD_HEAD = "**Điểm rèn luyện** của **{name}** (MSV: `{id}`):\n"
RECORD_LINE = "- **{term}**: **{score} điểm** — Xếp loại: {grade}"
