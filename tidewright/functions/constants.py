"""Fixed values that results depend on: patterns, word lists, tables and texts."""

import unicodedata

#: Code points that count as Vietnamese: the quick test (by lead byte) and the exact one.
FAST = r"[\x{C0}-\x{27F}\x{1000}-\x{1FFF}]"
EXACT = r"[\x{C0}-\x{24F}\x{300}-\x{36F}\x{1E00}-\x{1EFF}]"
EXACT_RANGES = ((0xC0, 0x24F), (0x300, 0x36F), (0x1E00, 0x1EFF))
MARK = r"[\x{300}-\x{36F}]"

_ID = r"[A-Za-z_\x{80}-\x{10FFFF}][A-Za-z0-9_\x{80}-\x{10FFFF}]*"
_WS = r"\n|[ \t\r\x0B\x0C]+"


def _quoted(q: str, keep: str) -> str:
    return rf"{q}[^{q}\\]*{keep}(?:\\(?s:.)[^{q}\\]*{keep})*{keep}(?:{q}|\\?\z)"


RAW_STRING = r'R"([^(]*)\((?s:.*?)\)\1"'


def _patterns(keep: str) -> tuple[str, str, str]:
    """Total token patterns of Python, JavaScript and C++: their matches tile any source. With ``keep`` as the sign + they give back nothing
    that they have matched: the same tokens, but a long literal takes no stack. SQL engines without that sign take the others."""
    python = ["#[^\\n]*", '"""(?s:.*?)"""', "'''(?s:.*?)'''", '"""(?s:.*)', "'''(?s:.*)", _quoted('"', keep), _quoted("'", keep), _ID, _WS, "[0-9][0-9A-Za-z._]*", "@[A-Za-z0-9_.]*", "(?s:.)"]
    script = ["//[^\\n]*", r"/\*(?s:.*?)\*/", r"/\*(?s:.*)", *(_quoted(q, keep) for q in "`\"'"), _ID, _WS, "[0-9][0-9A-Za-z._]*", "(?s:.)"]
    native = [
        "//[^\\n]*", r"/\*(?s:.*?)\*/", r"/\*(?s:.*)", RAW_STRING, _quoted('"', keep), _quoted("'", keep), _ID, rf"(?md:^)#(?:\\\n|[^\n])*{keep}", _WS, "[0-9][0-9A-Za-z.']*", "(?s:.)",
    ]
    return "|".join(python), "|".join(script), "|".join(native)


PYTHON, JAVASCRIPT, CPP = _patterns("+")
SQL_PYTHON, SQL_JAVASCRIPT, SQL_CPP = _patterns("")
IDENTIFIER = _ID

KEYWORDS = {
    "Python": "False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield".split(),
    "JavaScript": (
        "break case catch class const continue debugger default delete do else export extends false finally for function if import in instanceof let new null "
        "return static super switch this throw true try typeof var void while with yield async await of from as interface type enum implements declare abstract readonly namespace module"
    ).split(),
    "Cpp": (
        "alignas alignof and and_eq asm auto bitand bitor bool break case catch char char8_t char16_t char32_t class compl concept const consteval constexpr constinit "
        "const_cast continue co_await co_return co_yield decltype default delete do double dynamic_cast else enum explicit export extern false float for friend goto if inline "
        "int long mutable namespace new noexcept not not_eq nullptr operator or or_eq private protected public reinterpret_cast requires return short signed sizeof "
        "static static_assert static_cast struct switch template this thread_local throw true try typedef typeid typename union unsigned using virtual void volatile wchar_t while xor xor_eq"
    ).split(),
}

#: Vietnamese words without their marks.
WORDS = (
    "bai ban bao bat bien bo cai cam can cao cau chi cho chu co cong cot cua cuoi dang dao dat dau den di dia diem du dung duoc "
    "gia giao gioi giup gui hang hien hieu hinh ho hoc hop ke ket khai kham khach khi kiem ky lai lam lien loai lon lua "
    "luong ly ma mat mau menu mo moi mon muc nam nhap nhiem nho nhom nut phan phat phieu phong quan quyen quet san so soan su tai tam "
    "ten thay them thong thu thuc tiet tim tin tinh to toan tong trong truyen tuan tuy uong vai van vao viec vu xem xoa xuat yeu "
    "khachhang nhanvien soluong tenkhachhang danhsach quanly bienban bienche chinh chinhsach chucnang chucvu danhsachkhach dieukien donhang donvi "
    "giamsat giaotiep hethong hoatdong kiemtra kiemsoat loainhom loaitin madat mahoa makhach manhinh matkhau nguoidung nhanvienkinhdoanh phanbiet phanquyen "
    "quanlynhanvien quanlykho sanpham thanhphan thongtinnguoidung thongbao trangthai tiepnhan timkiem tuychinhtuy xulyanh xuatbao"
).split()
ABBREVIATIONS = (
    "BH BN CB CD CH CN CT CV DA DL DM QLKH QLNV NVKD DN DS DT DV GD GV HH HT ID KH KQ KT MA MB MH ML ND NH NL NV PB PC "
    "QC QL QLY QT SL SP ST TB TG TH TK TL TM TN TP TQ TT TV TX VA VT XL"
).split()
#: Names that the transliteration rule lets pass.
PASSED = (
    "token database manager valueerror keyerror typeerror attributeerror indexerror runtimeerror exception __init__ __str__ __repr__ __len__ __get__ __set__ handler service controller "
    "repository factory builder provider listener observer formatter validator serializer parser scanner lexer compiler emitter renderer dispatcher router middleware "
    "interceptor decorator adapter connector transformer cs fv idx ptr buf src dst cfg ctx err ret tmp val res req msg num pos off fn ok no op io db ui id os fs vm api"
).split()
#: Labels of the corpus builder: words (as far as lower-case words can match them) and abbreviation letters.
CORPUS_WORDS = (
    "ten tuoi diachi dienthoai email matkhau hoten ngaysinh gioitinh quequan quocgia thanhpho tinh huyen xa phuong "
    "danhmuc loai loaisanpham donvi soluong dongia thanhtien hoadon nhanvien khachhang sanpham nhacungcap kho tonkho "
    "xuatkho nhapkho phieuthu phieuchi baocao doanhthu chiphi thue phucap luong bangluong chamcong "
    "nguoidung dangnhap dangky xacthuc quanly phanquyen vaitro taikhoan phiengiam token cachep dulieu database "
    "bangdu truong giatri kieudu chuoi mangdu doituong benhvien hosobenh benhnhan bacsi phongkham lichkham "
    "ketqua xetnghiem dongthuoc thuoc benh trieuchung hocsinh giaovien lophoc monhoc diem bangdiem hocky truonghoc khoa nganh bangcap chungchi tenkhach"
).split()
CORPUS_ABBREVIATION = "^[BCDĐGHKLMNPQRSTVX]{2,6}$"
#: Of the example rules: a telephone number as a name, and two-letter abbreviations.
PHONE = "(?i)^(?:sdt|dienthoai|sodienthoai|phone)_?0[0-9]{9}$"
SHORT = {
    "hs": "hoc_sinh (student)", "nv": "nhan_vien (employee)", "kh": "khach_hang (customer)", "gv": "giao_vien (teacher)", "bv": "benh_vien (hospital)",
    "ql": "quan_ly (manager)", "sp": "san_pham (product)", "dh": "dai_hoc (university)", "tk": "tai_khoan (account)", "mk": "mat_khau (password)",
}

#: Letters whose marks can be stripped, by rule: the base letter, in lower case.
STRIPPED = "ÀÁÂÃÈÉÊÌÍÒÓÔÕÙÚÝàáâãèéêìíòóôõùúýĂăĐđƠơƯư" + "".join(map(chr, range(0x1EA0, 0x1EFA)))
BASES = "".join({"Đ": "d", "đ": "d"}.get(c, unicodedata.normalize("NFD", c)[0].lower()) for c in STRIPPED)

#: Id, name, description, category, severity of the rules.
RULES = [
    ("VL001", "Vietnamese Identifier", "Detects identifiers containing Vietnamese Unicode characters", "naming", "warning"),
    ("VL002", "Mixed-Language Comment", "Detects comments that mix Vietnamese and English text", "comments", "info"),
    ("VL003", "Encoding Declaration", "Validates encoding declaration in Python files", "encoding", "warning"),
    ("VL004", "Transliteration", "Detects Vietnamese words used without diacritics", "naming", "info"),
    ("VL005", "Unicode Normalization", "Ensures Vietnamese chars use NFC (precomposed) normalization", "encoding", "error"),
    ("VL006", "Consistent Naming Style", "Checks for consistent naming convention usage within file", "style", "info"),
    ("VL007", "Vietnamese in String Literals", "Detects Vietnamese text in string literals (i18n concern)", "style", "info"),
    ("VL008", "Inconsistent Transliteration Style", "Detects mixed snake_case and camelCase transliteration in same file", "naming", "warning"),
    ("VL009", "Vietnamese in Exception Message", "Detects Vietnamese text in exception/error messages", "i18n", "warning"),
    ("VL010", "Missing English Docstring", "Transliterated function missing English docstring", "documentation", "info"),
    ("VL011", "Vietnamese Import Alias", "Detects Vietnamese words used as import aliases", "naming", "warning"),
]

#: Messages of the rules, by the rule that says them; in two parts where a name or a style stands between.
MESSAGES = {
    "VL-EX-001": ("Identifier '", "' looks like a telephone number."),
    "VL-EX-002": ("Abbreviation '", "' may mean "),
    "VL001": ("Identifier '", "' contains Vietnamese characters. Consider using ASCII equivalents for better portability."),
    "VL001_MIXED": ("Identifier '", "' mixes Vietnamese and ASCII characters."),
    "VL001_PLAIN": ("Identifier '", "' appears to be a transliterated Vietnamese word. Consider using a more descriptive English name."),
    "VL002": "Comment mixes Vietnamese and English text. Consider using a single language for consistency.",
    "VL003": "Non-UTF-8 encoding declaration found. Vietnamese files should use UTF-8.",
    "VL004": ("'", "' looks like a transliterated Vietnamese word. Use descriptive English names for clarity."),
    "VL005": ("Identifier '", "' uses NFD (decomposed) Unicode normalization. Use NFC (precomposed) forms for Vietnamese characters."),
    "VL006": ("File uses mixed naming styles. Dominant: ", ". Consider standardizing to one style."),
    "VL007": "String literal contains Vietnamese characters. Consider externalizing to a localization file.",
    "VL008": ("Identifier '", "' uses inconsistent transliteration style. File predominantly uses "),
    "VL009": "Exception message contains Vietnamese text. Use English for better international compatibility.",
    "VL010": ("Transliterated function '", "' lacks an English docstring. Add a docstring explaining what this function does."),
    "VL011": ("Import alias '", "' appears to be Vietnamese. Use conventional English aliases (e.g., 'import numpy as np')."),
}

#: Characters of the bytes 0x80 to 0xFF in the legacy encodings; U+FFFD where there is none.
_TCVN3 = (
    "00C0 1EA2 00C3 1EA0 1EB0 1EAE 1EB2 1EB4 1EB6 00C8 1EBA 1EBC 1EB8 1EC0 1EBE 1EC2 1EC4 1EC6 00CC 1EC8 0128 1ECA 00D2 1ECE 00D5 1ECC 1ED2 1ED0 1ED4 1ED6 1ED8 1EDA "
    "1EDC 1EDE 1EE0 1EE2 00D9 1EE6 0168 1EE4 1EF2 1EF6 1EF8 00DD 1EF4 1EAC 1EB1 1EAF 00E0 1EA3 00E3 1EA1 1EB7 1EB3 1EB5 1EB5 1EB7 00E8 1EBB 1EBD 1EB9 1EC1 1EBF 1EC3 "
    "1EC5 1EC7 00EC 1EC9 0129 1ECB 00F2 1ECF 00F5 1ECD 1ED3 1ED1 1ED5 1ED7 1ED9 1EDB 1EDD 1EDF 1EE1 1EE3 00F9 1EE7 0169 1EE5 1EF3 1EF7 1EF9 00FD 1EF5 1EAD 0111 0110 "
    "0102 0103 01A0 01A1 01AF 01B0 0300 0301 0303 0309 0323 00E2 00EA 00F4 01A1 01B0 00C2 00CA 00D4 01A0 01AF 0110 0102 0103 01A1 01B0 0111 00E2 00EA 00F4 FFFD FFFD"
)
_VNI = (
    "00E0 1EA1 1EA3 00E3 1EA5 1EA7 1EA9 1EAB 1EAD 1EAF 1EB1 1EB3 1EB5 1EB7 00E8 1EB9 1EBB 1EBD 1EBF 1EC1 1EC3 1EC5 1EC7 00EC 1EC9 1ECB 1ECD 1ECF 1ED1 1ED3 1ED5 1ED7 "
    "1ED9 1EDB 1EDD 1EDF 1EE1 1EE3 00F9 1EE5 1EE7 1EE9 1EEB 1EED 1EEF 1EF1 1EF3 1EF5 1EF7 1EF9 00FD 00C0 1EA0 1EA2 00C3 1EA4 1EA6 1EA8 1EAA 1EAC 1EAE 1EB0 1EB2 1EB4 "
    "1EB6 00C8 1EB8 1EBA 1EBC 1EBE 1EC0 1EC2 1EC4 1EC6 00CC 1EC8 1ECA 1ECC 1ECE 1ED0 1ED2 1ED4 1ED6 1ED8 1EDA 1EDC 1EDE 1EE0 1EE2 00D9 1EE4 1EE6 1EE8 1EEA 1EEC 1EEE "
    "1EF0 1EF2 1EF4 1EF6 1EF8 00DD 0102 0103 01A0 01A1 01AF 01B0 0110 0111" + 18 * " FFFD"
)
HIGH_BYTES = "".join(map(chr, range(0x80, 0x100)))
CHARSETS = {
    "tcvn3": "".join(chr(int(x, 16)) for x in _TCVN3.split()),
    "vni": "".join(chr(int(x, 16)) for x in _VNI.split()),
    "windows-1258": bytes(range(0x80, 0x100)).decode("cp1258", errors="replace"),
}
