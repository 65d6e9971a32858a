"""Fixed values.

Everything here has to hold exactly these values for results to be right: word
lists, header hints, patterns and the wording of report labels.  They are
defaults; the operators that use them take them as parameters.
"""

# Characters removed from both ends of a cell before it is looked at (the
# Unicode white space set, not only U+0020).
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Whole-cell tokens that a scan reads as null (case sensitive).
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
)

# Lower-cased, trimmed tokens counted as blank, per job.
BLANK_TOKENS = {
    "clean": ("", "nan", "none", "nat", "<na>"),
    "split": ("", "nan", "none", "nat"),
    "merge": ("", "nan"),
    "compare": (),
}

# Header alias -> common header.
HEADER_ALIASES = {
    "手机": "手机号",
    "电话": "手机号",
    "联系电话": "手机号",
    "mobile": "手机号",
    "phone": "手机号",
    "tel": "手机号",
    "客户名": "姓名",
    "联系人": "姓名",
    "名字": "姓名",
    "邮件": "邮箱",
    "email": "邮箱",
    "mail": "邮箱",
    "e-mail": "邮箱",
    "销售金额": "销售额",
    "金额": "销售额",
    "营收": "销售额",
}

# A header containing one of these holds identifiers, kept as text.
TEXT_COLUMN_HINTS = (
    "手机", "电话", "联系方式", "mobile", "phone", "tel", "身份证", "证件号",
    "银行卡", "卡号", "订单号", "单号", "客户编号", "工号", "快递单",
)

# Header hints of the contact roles, in order of preference.
PHONE_HINTS = ("手机", "电话", "mobile", "phone")
EMAIL_HINTS = ("邮箱", "邮件", "email", "mail")
NAME_HINTS = ("姓名", "客户名", "联系人", "名字")
DATE_HINTS = ("日期", "下单", "时间", "入职")

# Header aliases of the sales roles, in order of preference.
SALES_ALIASES = {
    "person": ("销售人员", "业务员", "销售", "姓名", "员工", "负责人"),
    "amount": ("销售额", "金额", "成交额", "营收", "销售金额"),
    "qty": ("数量", "销量", "件数"),
    "product": ("产品", "商品", "品名", "SKU", "货品"),
    "date": ("日期", "成交日期", "下单日期", "销售日期", "时间"),
}

DEDUPE_KEY_PREFERENCE = ("手机号", "姓名", "身份证号", "邮箱", "订单号", "客户编号")
DEDUPE_KEY_HINT = "手机"
LATEST_COLUMN_HINTS = ("日期", "下单", "时间", "入职", "更新", "创建")
COMPARE_KEY_HINTS = ("手机", "订单", "编号", "邮箱")

PHONE_PATTERN = r"(?U)^1[3-9]\d{9}\z"
EMAIL_PATTERN = r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\z"
NAME_CHARACTER = "[一-鿿·]"

SOURCE_COLUMN = "来源文件"
SOURCE_COLUMN_TAKEN = "来源文件_原表"
BLANK_BUCKET = "空值"
DEFAULT_ROWS_PER_CHUNK = 1000

# Codes used in our columns -> wording used in reports.
LABELS = {
    "blank_row": "空白行",
    "full_duplicate": "完全重复行",
    "key_duplicate": "按{key}去重（{keep}）",
    "first": "保留第一条",
    "last": "保留最后一条",
    "latest": "按日期保留最新",
    "invalid_phone": "手机号不正确，需人工核对",
    "invalid_email": "邮箱不正确，需人工核对",
    "bad_date": "日期格式不对，需人工核对",
    "shift_ambiguous": "内容错列，去处不止一个，请人工判断",
    "shift_unrecognised": "内容错列，且有认不出的值，请人工判断",
    "missing_name": "没有姓名，请补上",
    "missing_phone": "没有手机号，请补上",
    "fix_trim": "姓名两端空白已去",
    "fix_shift": "错列的值已放回所属列",
    "fix_phone": "手机号只留数字",
    "fix_email": "邮箱去空白并改小写",
    "fix_date": "日期改写为 YYYY-MM-DD",
    "fixed": "已修复",
    "to_review": "待核对",
    "only_a": "仅在表A",
    "only_b": "仅在表B",
    "only_a_surplus": "仅在表A（同主键多余行）",
    "only_b_surplus": "仅在表B（同主键多余行）",
    "changed": "有变化",
    "same": "完全相同",
    "normal": "正常",
    "partly_empty": "部分为空",
    "all_empty": "全空",
    "absent": "本表无此列",
    "absent_header": "—（本表无此列）",
    "blank_key": "待人工补全拆分字段",
    "renamed": "文件名重复已自动加后缀",
    "short": "本批未满",
    "good": "良好",
    "fair": "一般",
    "poor": "较差",
    "advice_good": "可以使用；修复过的行请抽看几条。",
    "advice_fair": "请先看待核对的行，再抽看修复过的行。",
    "advice_poor": "请先补齐并核对标出的行，之后再使用这张表。",
}
