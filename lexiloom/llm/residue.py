"""Template residue, filler, error pages and script notices in place of content.

Each kind has its own grammar. Unfilled places: one grammar per delimiter. Messages: a
sentence that the page's machinery says, told by its build and not by its wording: a
status code with its reason, a failure verb with a part of the page as its object, a
part of the page in a state of failure, a demand to switch scripting on. Filler: a part
of the page that is yet to come, letters that follow the statistics of printers' mock
Latin, keys struck at random, one word over and over, items numbered and described by
their number.

What a text explains, quotes or translates is discounted by its surroundings: a
definition ("word (part of speech): ..."), quotation marks, a sentence beside its
translation, code, and words such as "is written" or "stands for" in a line that is
mostly words. None of it depends on how long a text is.

Cheap looks (a word that some grammar needs, an opening delimiter) decide which
sentences meet a grammar at all.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from math import log
from operator import eq

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexiloom.llm.consistent import SUSPECT, consistent
from lexiloom.session import spread

HARD = re.compile(SUSPECT)

# ---- unfilled places -------------------------------------------------------------------

_NAME = r"[^\W\d][\w.]*(?: [\w.]+){0,3}"  # a name, or a few words
_ID = r"[^\W\d][\w.]+"  # one name of two characters or more
#: A path of names with indexes and calls, and filters behind it.
_PATH = r"[^\W\d][\w.\-]*(?:\[[^\]\n]*\]|\([^()\n]*\))*(?:\.[\w.\-]+(?:\[[^\]\n]*\]|\([^()\n]*\))*)*(?: [\w.]+){0,3}"
_FILTERS = r"(?: ?\|\|? ?[\w\"'.][^{}|\n]*)*"
#: Signs by which control and inclusion tags begin.
_SIGIL = r"[#/^>&~!=@-]?"

# Delimiters of unfilled places, the strict ones first.
PLACES = re.compile(
    "|".join(
        (
            rf"\{{\{{\{{? ?{_SIGIL} ?{_PATH}{_FILTERS} ?\}}?\}}\}}",  # {{name}} {{a.b | upper}} {{#if name}} {{{name}}}
            r"\{%-? ?[^\W\d]\w*[^%{}\n]*?-?%\}",  # {% name %} {% if x == 1 %}
            rf"[$#]\{{{_PATH}(?::[^{{}}\n]*)?\}}",  # ${name} ${name:-none} #{name}
            rf"<%[=\-@]? ?{_PATH} ?-?%>|<\?(?:=|php(?: echo)?)? ?\$?{_PATH} ?;? ?\?>",  # <%= name %> <?= $name ?>
            rf"&lt;/?{_NAME}/?&gt;|<<{_NAME}>>|<{_ID}/>",  # &lt;name&gt; <<name>> <name/>
            rf"<(?:your|insert|enter|nhập|điền|chèn)[ _-]{_NAME}>",  # <your name here>
            rf"\[\[{_NAME}\]\]|@@{_NAME}@@",  # [[name]] @@name@@
            rf"\[(?:todo|fixme|insert|enter|your|chèn|điền|nhập|tbd)\b:? ?{_NAME}\]",  # [TODO: name] [Your Name]
            rf"\((?:điền|chèn|nhập|insert|enter) {_NAME} (?:vào đây|ở đây|tại đây|here)\)",  # (điền name vào đây)
            rf"%\({_ID}\)[sdf]|%{_ID}%|(?<![\w$])\${_ID}\$(?![\w$])",  # %(name)s %name% $name$
            rf"XXX_{_NAME}_XXX|(?<!\w)__{_NAME}__(?!\w)",  # XXX_name_XXX __name__
            rf"(?<![\w{{])\{{{_ID}\}}(?!\}})",  # {name}
            rf"(?<![\w~])~{_ID}~(?![\w~])|(?<![\w:]):{_ID}:(?![\w:])",  # ~name~ :name:
            rf"(?<![\w\[])\[{_NAME}\](?![\w\](])",  # [name]
        )
    ),
    re.IGNORECASE,
)
_PLACE_STARTS = re.compile(r"[{$#<\[%~]|&lt;|@@|\((?=[^\W\d])|xxx_|__|:(?=\w)", re.IGNORECASE)
#: A bracketed word may be an ordinary remark ...
_REMARK = re.compile(r"\[[^\[\]:]*\]\Z")
_ORDER = re.compile(r"\[(?:todo|fixme|insert|enter|your|chèn|điền|nhập|tbd)\b", re.IGNORECASE)
#: ... but it is a place where its line lacks a word: at its start, behind a mark, or
#: behind a word that needs another (a preposition, a greeting, a linking verb).
_LACKS = re.compile(
    r"(?:^|[-*=+/:,]\s?|\b(?:dear|hello|hi|welcome|to|of|for|by|from|with|at|in|about|named|called|is|are|was|be|up|the|an?|"
    r"từ|là|nhật:|nghĩa|của|cho|với|bởi|về|tên|chào|ông|bà|anh|chị|gửi|ngày) )\Z",
    re.MULTILINE | re.IGNORECASE,
)

# ---- messages --------------------------------------------------------------------------

#: Parts of a machine or of a page, which cannot be met outside of one ...
_MACHINE = (
    r"(?:web ?)?(?:page|site)s?|server|service|url|link|request(?:ed \w+)?|session|connection|database|host|gateway|proxy|network|"
    r"account|application|app|system|file|resource|login|api|domain|certificate|token"
)
#: ... and what a page shows, which can.
_SHOWN = (
    r"entry|entries|articles?|lists?|sections?|content|contents|examples?|pronunciations?|results?|data|definitions?|audio|dictionary|"
    r"images?|videos?|search|query|queries|form|item|record|document|comments?|preview|details?|address|map|chart"
)
_THING = rf"(?:(?:{_MACHINE}|{_SHOWN})\b|/\w\S*)"
_SORRY = r"(?:(?:we are |we're |i'm )?sorry|oops|whoops|hmm+|uh-oh|unfortunately|we apologi[sz]e|apologies|ah|error|failed|failure)\b ?[,!.:]* ?(?:but )?"
_FAIL = (
    r"(?:(?:could|can|did|does|do|will)(?: not|n't|n’t)|cannot|can't|(?:was |were |is |are |am )?(?:unable|not able) to|fail(?:ed|s)? to)(?: seem to| be)? "
    r"(?:re)?(?:load|open|show|display|find|locate|fetch|retriev|reach|connect|process|complet|render|sav|updat|access|get|read|play|handl|serv|"
    r"perform|verif|establish|resolv|authenticat|submit|send|pars|fulfil|continue|generat|creat)\w*\b"
)
#: Reason phrases of the HTTP status codes 4xx and 5xx.
REASONS = (
    "bad request", "unauthorized", "payment required", "forbidden", "not found", "method not allowed", "not acceptable", "proxy authentication required",
    "request time-?out", "conflict", "gone", "length required", "precondition failed", "(?:content|payload) too large", "uri too long",
    "unsupported media type", "range not satisfiable", "expectation failed", "misdirected request", "unprocessable (?:content|entity)", "locked",
    "failed dependency", "too early", "upgrade required", "precondition required", "too many requests", "request header fields too large",
    "unavailable for legal reasons", "internal server error", "not implemented", "bad gateway", "service (?:temporarily )?unavailable", "gateway time-?out",
    "http version not supported", "variant also negotiates", "insufficient storage", "loop detected", "network authentication required",
)
_REASON = rf"(?:{'|'.join(REASONS)}|không tìm thấy|không có quyền|máy chủ\b|lỗi máy chủ)"
#: Reason phrases that say all by themselves; the others are everyday words, too.
_TELLING = "|".join(r for r in REASONS if r.endswith(("error", "gateway", "time-?out", "unavailable", "request", "requests", "allowed", "required", "supported")))

_TIEC = r"(?:xin lỗi|rất tiếc|thật tiếc|thành thật xin lỗi|tiếc quá|ôi|úi|hiện tại|hiện nay|hiện)\b ?[,!.:]* ?"
_MAY = r"(?:chúng tôi|hệ thống|máy chủ|trình duyệt|ứng dụng|trang web|trang này|trang|website|dịch vụ)"
_PHAN = (
    r"(?:trang(?! sách| báo| giấy| bị| vở| nhà| phục)|nội dung|dữ liệu|máy chủ|dịch vụ|yêu cầu|kết quả|danh sách|(?:phần |câu |các )?ví dụ|phần|mục|bài|"
    r"phát âm|định nghĩa|tệp|tài liệu|đường dẫn|liên kết|địa chỉ|hình ảnh|từ điển|kết nối|cơ sở dữ liệu|âm thanh|tài nguyên|tập tin)"
)
_STATE = (
    r"(?:not (?:be )?(?:found|available|exist|respond\w*|load\w*|display\w*|shown|reach\w*|work\w*|open\w*|access\w*|safe|secure|private|accept\w*|recogni[sz]ed)|"
    r"n't (?:be )?(?:found|available|exist|respond\w*|load\w*|display\w*|shown|reach\w*|work\w*|open\w*|access\w*)|"
    r"unavailable|unreachable|offline|overloaded|under (?:construction|maintenance)|being (?:updated|maintained)|"
    r"expired|timed out|time out|denied|refused|rejected|blocked|suspended|forbidden|reset|down(?! (?:the|on|to|by))|"
    r"gone|(?:been )?(?:moved|removed|deleted|closed|disabled|lost|interrupted|terminated)|no longer (?:exists?|available)|"
    r"(?:temporarily|currently) \w+|too long to respond|an? (?:error|problem))"
)

# What the page's machinery says, from the start of a line or sentence.
ERRORS_EN = (
    # a status: code and reason, or a reason that says all by itself
    rf"(?:http(?:/\d(?:\.\d)?)?(?: error| status)?|(?:status|error)(?: code)?|code|lỗi|mã lỗi)[ :#]*[45]\d\d\b(?=\s*(?:$|[-–—:.,!(])|\s+{_REASON})",
    rf"[45]\d\d\s*[-–—:|]?\s*(?:{_REASON}\s*[.!]?\s*$|(?:{_TELLING})\b)",
    rf"(?:{_TELLING})\s*[.!]?\s*$",
    r"(?:page|file|url|resource|site|host|server|document)s? (?:was |is )?not found\b",
    # a failure verb with a part of the page as its object
    rf"(?:{_SORRY})?(?:we |i |it |(?:the|this|your|our) (?:\w+ )?(?:{_MACHINE}|browser) |(?:server|browser|site) )?{_FAIL}[^.!?\n]*\b{_THING}",
    rf"{_SORRY}(?:something|nothing|there (?:was|is|were)|the |that |this |an? (?:\w+ )?(?:error|problem)|your |no \w+|it (?:looks|seems))",
    rf"(?:{_SORRY})?(?:(?:an?|some|the) )?(?:(?:unexpected|unknown|internal|fatal|critical|application|server|database|network|system|runtime|script|unhandled|technical) )*(?:errors?|exception|problem|glitch)(?: has| have)? (?:occurred|happened|been encountered|was encountered|prevented)",
    rf"(?:{_SORRY})?there (?:was|is|has been) (?:an?|some) (?:\w+ )?(?:error|problem|issue) (?:\w+ing|with|on|in) [^.!?\n]*\b{_THING}",
    rf"(?:{_SORRY})?error (?:while |when |in )?(?:establish|connect|load|open|read|process|fetch|retriev|sav|send|writ|render|pars)ing\b|(?:{_SORRY})?(?:we're |we are |we have )?(?:having )?trouble \w+ing [^.!?\n]*\b{_THING}",
    rf"(?:{_SORRY})?something (?:went|has gone|is) wrong\b(?:[.!]|$| on our| while|[^.!?\n]*\b{_THING})",
    # a part of the page in a state of failure
    rf"(?:(?:the|this|that|your|our) )?(?:requested |following |current )?(?:{_MACHINE})\b(?: \S*/\S*)?(?: (?:you|that|for|at|to|on|from|with|server|request)\b(?:[^.!?\n]|\.(?=\w))*?)? ?(?:is|are|was|were|has|have|had|can?|could|does|do|did|may|might|will|wo|took)(?: \w+)??[ ']?{_STATE}",
    rf"the requested (?:{_MACHINE}|{_SHOWN})\b",
    rf"(?:this|the) (?:{_SHOWN}) (?:is|are|has|was|cannot|can not|can't|could not|will)(?: be)? (?:(?:currently|temporarily) )?(?:un(?:available|der (?:construction|maintenance))|not available|offline|(?:been )?(?:removed|deleted|blocked)|(?:loaded|displayed|shown)|down for)\b",
    rf"(?:(?:the|this|that|your|our) )?(?:{_MACHINE}|browser)\b (?:has |have )?(?:encountered|returned|reported|experienced|met|raised|thrown|hit) (?:an?|some|the) [^.!?\n]*(?:error|problem|exception|failure)",
    r"(?:connection|request|operation|session|server|database|host|read|write|login)(?: \w+)? (?:timed out|time-?out|timeout|refused|reset|expired|closed|aborted|lost|failed|error)\b",
    r"no (?:internet|network|database)(?: connection)?\b|you (?:are|seem to be|appear to be) (?:currently )?offline",
    # permission, quotas, checks of the visitor
    r"you (?:do not|don't|don’t) have (?:the )?(?:\w+ )?(?:permissions?|access|rights?|privileges?|authori[sz]ation)\b",
    rf"you (?:are|were) not (?:authori[sz]ed|allowed|permitted|logged in)\b[^.!?\n]*\b{_THING}|you must (?:be logged in|log in|sign in)",
    r"(?:access|permission)(?: to \S+(?: \w+)?)?(?: is| was| has been)? (?:denied|forbidden|restricted|refused)\b",
    r"(?:please )?(?:log|sign) in to (?:view|continue|see|access|read|proceed)\b|(?:login|authentication|authori[sz]ation) (?:is )?(?:required|failed)",
    r"(?:too many|you have (?:made|sent|reached|exceeded)(?: \w+){0,3}) (?:\w+ )?(?:requests|attempts|lookups|searches|connections|queries|logins|limit|quota)\b",
    r"(?:rate|request|usage|quota|bandwidth|memory|download) (?:limit )?(?:was |has been |is )?(?:exceeded|exhausted|reached)",
    r"(?:checking|verifying) (?:your|the|if your|that your) (?:browser|connection|site connection|identity)",
    r"(?:please )?(?:verify|confirm|prove)(?: that)? you(?:'re| are) (?:a )?(?:human|not a robot)|(?:please )?(?:complete|solve) the captcha",
    r"(?:please )?(?:reload|refresh) (?:the|this|your) (?:page|browser)\b",
)
# the same in Vietnamese
ERRORS_VI = (
    rf"(?:{_TIEC})?(?:{_MAY} )?(?:đang |hiện |tạm thời |đã |vẫn )?(?:không thể|không|chưa thể|chưa|chẳng)(?: thể)? (?:tải|mở|hiển thị|tìm|kết nối|truy cập|xử lý|lấy|phát|đọc|gửi|lưu|nạp|cập nhật)(?: thấy| được| lại| đến| tới| vào| với)*[^.!?\n]*\b{_PHAN}",
    rf"{_TIEC}(?:{_MAY} )?(?:không (?:thể|có dữ liệu|tìm thấy|tải được|mở được)|đã (?:có|xảy ra)|có lỗi|chưa (?:mở|tải|tìm|hiển thị|có)|{_MAY} (?:đang )?(?:gặp|quá tải|bảo trì)|đang (?:gặp|quá tải|bảo trì))",
    r"(?:đã )?(?:có|xảy ra|gặp|phát sinh)(?: một)? (?:lỗi|sự cố)(?: đã)?(?: (?:xảy ra|hệ thống|máy chủ|kết nối|không (?:xác định|mong muốn)|khi|trong)|[.!]|$)",
    r"lỗi (?:hệ thống|máy chủ|kết nối|không xác định|cơ sở dữ liệu|truy vấn|nội bộ)\b",
    rf"(?:{_MAY}|mục này|phần này|bài này|phiên (?:làm việc|đăng nhập)|đường dẫn|liên kết|kết nối|yêu cầu|địa chỉ|tài khoản|tệp|cơ sở dữ liệu)\b[^.!?\n]*?(?:quá tải|bảo trì|không (?:phản hồi|tồn tại|hoạt động|khả dụng|hợp lệ|tìm thấy|còn)|gặp (?:sự cố|lỗi)|hết hạn|tạm ngưng|tạm ngừng|tạm dừng|ngừng|gián đoạn|xây dựng|quá thời gian|đã (?:bị xóa|bị gỡ|hết)|bị (?:từ chối|chặn|khóa|ngắt|mất))",
    rf"không (?:tìm thấy|tồn tại) {_PHAN}(?: này| yêu cầu| bạn [^.!?\n]*)?[.!]?\s*$",
    r"bạn (?:không|chưa)(?: có| được)?(?: cấp| phép)? quyền\b|bạn (?:không|chưa) được phép (?:truy cập|xem|mở|đọc|vào)|(?:truy cập|quyền truy cập) (?:đã )?bị từ chối|từ chối truy cập",
    r"(?:vui lòng|hãy|bạn (?:cần|phải)) đăng nhập (?:để|trước)|quá nhiều (?:yêu cầu|lượt|truy vấn|lần)",
    r"(?:vui lòng|hãy) (?:tải lại|làm mới) trang\b|đang kiểm tra trình duyệt",
)
TRACES = (
    r"traceback \(most recent call last\)",
    r'file ".+", line \d+, in ',
    r"at [\w.$<>]+\([\w.]+(?::\d+)?\)",
    r"(?:uncaught |unhandled )?(?:[\w$]+\.)*[a-z]\w*(?:Exception|Error)\b: ",
    r"(?:php )?(?:warning|notice|fatal error|parse error|deprecated): .+ (?:in \S+ )?on line \d+",
    r"(?:warning|notice|fatal error|parse error): (?:undefined|mysqli?|include|require|call to|cannot|uncaught|division)",
    r"error: (?:relation|column|syntax error|duplicate key|function|permission|near|connection|could not) ",
    r"error \d+(?: ?\(\w+\))?: ",
    r"(?:sql)?state\[?\w+\]?: |ora-\d{5}\b|(?:exception in thread|caused by:|stack trace:|segmentation fault|core dumped|panic:)",
)

#: What runs in a page.
_SCRIPT = r"(?:java ?scripts?|js|scripts?|scripting|client-side (?:code|scripts?)|active content|mã kịch bản|mã lệnh|tập lệnh|kịch bản trang|nội dung động)\b"
_COOKIES = r"cookies?\b"
_ON = r"(?:enabl|activat|allow|permit|unblock|accept)\w*|(?:turn|switch)\w*(?: back)? on|bật|kích hoạt|cho phép|mở"
_ASKS = r"(?:please|kindly|to|for|in order to|before|if|you|we|your|enable|activate|allow|permit|unblock|turn|switch|vui lòng|hãy|xin|cần|bạn|muốn|để|trước khi|mời|phải|bật|kích hoạt|cho phép)\b"
# Demands to switch scripting on; each is held against a whole sentence.
SCRIPTS = (
    rf"(?:{_ASKS}[^.!?\n]*?\b)?(?:{_ON}) (?:(?:the|your|its?|all|any|lại|chạy|cho|browser's) )*(?:{_SCRIPT}|{_COOKIES})",
    rf"(?:{_ASKS}[^.!?\n]*?\b)?(?:turn|switch) (?:{_SCRIPT}|{_COOKIES})(?: back)? on",
    rf"(?:{_SCRIPT}|{_COOKIES})(?: support| and scripts?| and cookies)? (?:(?:is|are|has been|have been|must be|needs? to be|should be|seems? to be|appears? to be|was) )?(?:(?:currently|also|either) )*(?:required|needed|disabled|enabled|off|switched off|turned off|turned on|switched on|blocked|allowed|unavailable|not (?:enabled|supported|available|allowed|active))",
    rf"(?:(?:this|the|our|these) )?(?:\w+ ){{0,2}}?(?:{_MACHINE}|{_SHOWN}|parts?|features?)\b[^.!?\n]*?\b(?:needs?|requires?|relies on|depends on|works? (?:only|best) with|use[sd]?|without|runs? on) (?:\w+ )?{_SCRIPT}",
    rf"(?:trang|từ điển|mục|ứng dụng|phần|bài|nội dung|website)\b[^.!?\n]*?\b(?:cần|đòi hỏi|yêu cầu|dùng|sử dụng)(?: có| bật| đến| tới)* {_SCRIPT}",
    rf"(?:(?:your|the|this) )?browser\b[^.!?\n]*?(?:not|n't|disabled|blocks?|blocking|off|without|no|lacks?|has)\b[^.!?\n]*?{_SCRIPT}",
    rf"trình duyệt\b[^.!?\n]*?\b(?:chặn|tắt|không|chưa|thiếu)\b[^.!?\n]*?{_SCRIPT}",
    rf"(?:bạn|hình như bạn|có vẻ bạn)\b[^.!?\n]*?\b(?:tắt|chưa bật|chưa kích hoạt|chưa mở|đang chặn|đã chặn|vô hiệu)[^.!?\n]*?{_SCRIPT}",
    rf"{_SCRIPT} (?:đang |đã |hiện |chưa )*(?:bị )?(?:tắt|chặn|vô hiệu|không được hỗ trợ|chưa (?:được )?bật|cần được bật|được bật|phải được bật)",
    rf"(?:không có|thiếu|chưa có) {_SCRIPT}",
    rf"(?:(?:it )?(?:looks|seems|appears)(?: like| that| as if)? )?you (?:have|seem to have|appear to have|need|must have) (?:\w+ ){{0,2}}?{_SCRIPT}(?: (?:turned off|disabled|switched off|blocked|off|enabled|on|turned on))?",
    r"noscript\b ?:?",
)

# ---- filler ----------------------------------------------------------------------------

_PART = r"(?:text|content|contents|description|title|heading|headline|image|photo|logo|paragraph|section|article|page|entry|examples?|details?|body|name|caption|summary|translation|definition|meaning|pronunciation|information|info|copy|sentence|headword)"
_PHAN_VAN = r"(?:nội dung|bài viết|bài|mục|phần|trang|ví dụ|mô tả|văn bản|đoạn văn bản|đoạn văn|đoạn|tiêu đề|nghĩa|phiên âm|định nghĩa|bản dịch|thông tin|chi tiết)"
FILLER_EN = (
    # a part of the page that goes where the words stand
    rf"(?:(?:your|the|some|an?|put|insert|add) )?(?:\w+ )?{_PART}(?: (?:text|name))? (?:goes|comes|will go|will be|should go|belongs) here\b",
    rf"(?:type|enter|write|insert|put|add|place|paste)(?: (?:the|your|an?|some|in))? [^.!?\n]*\b(?:here|below this line)\b[.!…]*\s*$",
    rf"(?:(?:this|here) is )?(?:an? |the |just |some )*(?:placeholder|dummy|filler|sample|default|blind)(?: (?:body|text|content|paragraph|copy|page|entry|image|title))?\b(?: ?[,.:!]| only| used| to be| for| until| and should| that| which|\s*$)",
    rf"(?:please )?(?:replace|change|edit|delete) this (?:\w+ )?{_PART}\b",
    # a part of the page that is yet to come
    rf"(?:(?:the |this |more |an? |full )?(?:\w+ )?{_PART}s? )?(?:is |are )?(?:coming soon|to be (?:completed|added|written|filled in|announced|determined|translated|provided|updated|confirmed|defined)|not (?:yet )?(?:available|written|added|translated)(?: yet)?|being (?:written|updated|translated|prepared)|pending)(?: by [^.!?\n]*| later| soon| yet| here)?[.!…]*\s*$",
    r"(?:tbd|tba|tbc|todo|fixme|xxx|wip)[.:!]?\s*$",
    r"(?:todo|fixme|to do|xxx|wip)\b ?[:\-–]? ?(?:write|add|fill|insert|describe|complete|translate|check|fix|update|replace|remove|verify|ask|finish|find|viết|thêm|bổ sung|điền|dịch|sửa|kiểm tra|cập nhật)\b",
    rf"\(?(?:no|missing|empty|add) (?:{_PART}|data)s?(?: (?:yet|available|here|found|to (?:show|display)))*\)?[.!]?\s*$",
)
FILLER_VI = (
    rf"\(?(?:{_PHAN_VAN} này )?(?:chưa có|không có|thiếu|trống|chưa nhập|đang chờ) (?:{_PHAN_VAN}|dữ liệu)(?: nào| để hiển thị)?\)?[.!]?\s*$",
    rf"(?:đây (?:chỉ )?là )?(?:một )?{_PHAN_VAN} (?:mẫu|thử|giả|thử nghiệm|giữ chỗ|tạm)(?: ?[,.:!]| để| dùng|\s*$)",
    rf"{_PHAN_VAN}(?: \w+)?(?: này)? (?:đang|sẽ|sẽ sớm|hiện đang) (?:được )?(?:cập nhật|bổ sung|biên soạn|hoàn thiện|soạn|viết|thêm|dịch|chờ)(?: sau| sớm| thêm| trong [^.!?\n]*|,[^.!?\n]*)?[.!…]*\s*$",
    r"(?:đang (?:được )?(?:cập nhật|biên soạn|hoàn thiện)|sắp ra mắt|sắp có|chờ (?:bổ sung|cập nhật))[.!…]*\s*$",
    rf"(?:nhập|điền|gõ|viết|thêm|chèn|đặt) [^.!?\n]*\b(?:vào đây|ở đây|tại đây)\b",
    rf"(?:hãy |vui lòng )?thay (?:thế )?(?:{_PHAN_VAN}|nó|dòng) (?:này )?(?:bằng|với)\b",
)
#: Items named by a number alone and described by that name: two of them or more.
NUMBERED = re.compile(r"(?:^[^\w\n]*([^\W\d]+ \d+)[^\w\n]*\n[^\n]*\b\1\b[^\w\n]*(?:\n\s*)*){2,}", re.MULTILINE | re.IGNORECASE)
_NUMBER_ENDS = re.compile(r"\d[^\w\n]*\n")
REPEAT = re.compile(r"(?<!\S)([^\W_]{1,8})(?:(?:[ \t]*\n[ \t]*|[ \t]+|[ \t]*[-–,.][ \t]*)\1(?![^\W_])){3,}", re.IGNORECASE)
#: Keys of one row, struck at random: no words are made of them alone for that long.
MASH = re.compile(r"^[-*=+•·#> \t]*+(?=[^\n]*[a-z]{5})[asdfghjkl; \t]{18,}$|^[-*=+•·#> \t]*+(?=[^\n]*[a-z]{5})[zxcvbnm,. \t]{18,}$", re.MULTILINE)

# The passages that mock Latin is made of, whose letters it follows, and
# English of the same length for comparison.
_LATIN = """
Lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua. Ut enim ad minim
veniam quis nostrud exercitation ullamco laboris nisi ut aliquip ex ea commodo consequat. Duis aute irure dolor in reprehenderit in voluptate
velit esse cillum dolore eu fugiat nulla pariatur. Excepteur sint occaecat cupidatat non proident sunt in culpa qui officia deserunt mollit
anim id est laborum. Sed ut perspiciatis unde omnis iste natus error sit voluptatem accusantium doloremque laudantium totam rem aperiam eaque
ipsa quae ab illo inventore veritatis et quasi architecto beatae vitae dicta sunt explicabo. Nemo enim ipsam voluptatem quia voluptas sit
aspernatur aut odit aut fugit sed quia consequuntur magni dolores eos qui ratione voluptatem sequi nesciunt. Neque porro quisquam est qui
dolorem ipsum quia dolor sit amet consectetur adipisci velit sed quia non numquam eius modi tempora incidunt ut labore et dolore magnam
aliquam quaerat voluptatem. Ut enim ad minima veniam quis nostrum exercitationem ullam corporis suscipit laboriosam nisi ut aliquid ex ea
commodi consequatur. Quis autem vel eum iure reprehenderit qui in ea voluptate velit esse quam nihil molestiae consequatur vel illum qui
dolorem eum fugiat quo voluptas nulla pariatur. At vero eos et accusamus et iusto odio dignissimos ducimus qui blanditiis praesentium
voluptatum deleniti atque corrupti quos dolores et quas molestias excepturi sint occaecati cupiditate non provident similique sunt in culpa
qui officia deserunt mollitia animi id est laborum et dolorum fuga. Et harum quidem rerum facilis est et expedita distinctio.
"""
_ENGLISH = """
The farmer walked down the narrow road before the market opened and carried a basket of bread under his arm. When we reached the house nobody
answered the door, so my sister sat on the stairs while I looked through the kitchen window. A word may have several meanings, and the way in
which people use it often depends on where they live. Some of them speak quickly, others think for a long time before they say anything at
all. Yesterday the teacher gave every child a new book with pictures of birds, ships and mountains. They should have started earlier because
the weather was getting worse. After dinner he wrote three letters, closed his bag and went out without telling her where he would be going.
This machine makes a strange noise whenever it is switched off too fast. You can find good coffee near the station, but the old shop by the
bridge has been closed since last winter. Both brothers knew how to repair clocks, although neither had ever learned it at school. Water
runs through the pipe into a large tank, which feeds the garden during dry months. Who left these heavy boxes in front of the gate again?
Most visitors enjoy walking along the river, watching the boats and listening to children play. It took years to build the wall, yet one
storm was enough to break it. Perhaps someone will remember the right answer tomorrow morning. Their neighbours grow apples, onions and
potatoes, keep chickens, and sell eggs cheaply. There is nothing wrong with asking twice if the first reply was not clear enough to follow.
"""


def _letters(text: str) -> Counter:
    return Counter(w[i : i + 3] for w in (f"^{x}$" for x in re.findall("[a-z]+", text.lower())) for i in range(len(w) - 2))


def _statistics() -> dict[str, float]:
    """Per letter triple, how much likelier it is in mock Latin than in English."""
    latin, english = _letters(_LATIN), _letters(_ENGLISH)
    a, b, kinds = sum(latin.values()), sum(english.values()), len(latin | english)
    return {g: log((latin[g] + 0.5) / (a + 0.5 * kinds)) - log((english[g] + 0.5) / (b + 0.5 * kinds)) for g in latin | english}


TRIPLES = _statistics()
#: Mean gain of the letter triples of words in a row from which on they are mock Latin.
LATIN_GAIN = 0.4
#: ... if together they are a million times likelier there than in English.
LATIN_ODDS = log(1e6)
_ENGLISH_WORDS = frozenset(re.findall("[a-z]+", _ENGLISH.lower())) - frozenset(re.findall("[a-z]+", _LATIN.lower())) - {"a"}
_SENTENCE_ENDS = re.compile(r"[.!?\n]+")


@lru_cache(maxsize=100_000)
def _gain(word: str) -> tuple[float, int] | None:
    """Sum and number of a word's letter triples; None of everyday English or of letters beyond a-z."""
    word = word.strip(",;:()\"'")
    if not word.isascii() or not word.isalpha() or word in _ENGLISH_WORDS:
        return None
    padded = f"^{word}$"
    return sum(TRIPLES.get(padded[i : i + 3], 0.0) for i in range(len(word))), len(word)


def mock_latin(low: str) -> Iterator[int]:
    """Where four words or more in a row of one sentence follow the letters of mock Latin."""
    start = 0
    for end in (*(m.start() for m in _SENTENCE_ENDS.finditer(low)), len(low)):
        total, letters, n = 0.0, 0, 0
        for g in (*map(_gain, low[start:end].split()), None):
            if g is not None:
                total, letters, n = total + g[0], letters + g[1], n + 1
                continue
            if n >= 4 and total > max(LATIN_ODDS, LATIN_GAIN * letters):
                yield (start + end) // 2
            total, letters, n = 0.0, 0, 0
        start = end


# ---- surroundings ----------------------------------------------------------------------

#: Where a line or sentence starts, behind its bullets.
STARTS = re.compile(r"^[-*=+•·#> \t(]*+|[.!?…:][\"”)]?[ \t]+", re.MULTILINE)


@dataclass(frozen=True)
class Family:
    """Grammars that a lower-cased text meets only if it holds one of some words."""

    needs: tuple[str, ...]
    grammar: re.Pattern


def _family(needs: str, grammars: tuple[str, ...]) -> Family:
    return Family(tuple(needs.split("|")), re.compile("|".join(f"(?:{p.lower() if p in TRACES else p})" for p in grammars), re.MULTILINE))


FAMILIES = (
    _family(
        "error|sorry|oops|whoops|hmm|uh-oh|unfortunately|apolog|ah,|could not|n't|n’t|cannot|can not|not found|unable|not able|fail|did not|went wrong|gone wrong|is wrong|"
        "problem|exception|glitch|denied|forbidden|unauthor|restricted|time-out|timeout|timed out|expired|refused|too many|exceed|exhaust|limit|quota|checking|verify|robot|human|captcha|"
        "reload|refresh|unavailable|not available|offline|maintenance|construction|requested|log in|sign in|login|authentic|not respond|overloaded|no internet|no network|no database|no longer|"
        "not exist|removed|moved|deleted|reset|aborted|closed|suspended|blocked|rejected| down|too long|not authori|not allowed|not permitted|not have|not be|temporarily|currently|is not |are not |trouble|encountered|returned an|"
        "bad request|not acceptable|conflict|gone|required|too large|unsupported|unprocessable|locked|too early|not implemented|gateway|not supported|insufficient|loop detected|500|501|502|503|504|505|"
        "400|401|402|403|404|405|406|407|408|409|410|411|412|413|414|415|416|417|418|421|422|423|424|425|426|428|429|431|451|50|51|52|53",
        ERRORS_EN,
    ),
    _family(
        "lỗi|tiếc|không thể|không tìm|không tải|không mở|không tồn|không phản hồi|không hoạt động|không kết nối|không truy cập|không khả dụng|không hợp lệ|không có|không hiển thị|không còn|"
        "không được|được phép|không phát|không đọc|không lấy|không xử lý|không gửi|không lưu|không nạp|chưa tải|chưa mở|chưa tìm|chưa hiển thị|chưa thể|chưa có|chưa kết nối|chưa được|chẳng thể|chẳng t|quá tải|bảo trì|"
        "hết hạn|sự cố|từ chối|gián đoạn|ngừng|ngưng|tạm dừng|xây dựng|quá thời gian|quyền|đăng nhập|quá nhiều|tải lại|làm mới|kiểm tra trình duyệt|bị chặn|bị khóa|bị ngắt|bị mất|bị gỡ|bị xóa|đã hết",
        ERRORS_VI,
    ),
    _family('traceback|", line |error:|exception|.java:|(|warning:|notice:|deprecated:|on line |state|ora-|caused by|stack trace|segmentation|core dumped|panic:', TRACES),
    _family("script|js|active content|client-side|cookie|mã lệnh|tập lệnh|kịch bản|nội dung động", SCRIPTS),
    _family(
        "here|below|placeholder|dummy|filler|sample|default|blind|soon|to be |not available|not written|not added|not translated|not yet|being |pending|tbd|tba|tbc|todo|to do|fixme|xxx|wip|no |missing|empty|add |"
        "replace this|change this|edit this|delete this",
        FILLER_EN,
    ),
    _family("đang |sẽ |sắp |mẫu|giả|thử|tạm|giữ chỗ|chưa có|không có|thiếu|trống|chưa nhập|đây|thay |chờ ", FILLER_VI),
)
#: A headword, its part of speech in brackets, a colon.
DEFINITION = re.compile(r"^[^\n(:.!?]+\([^()\n]*(?:\btừ\b|\bngữ\b|\bnoun\b|\bverb\b|\badjective\b|\badverb\b|\bphrase\b|\bn\.|\bv\.|\badj\.)[^()\n]*\): ?", re.IGNORECASE)
EXPLAINS = re.compile(
    r"\b(?:such as|for example|for instance|is written|are written|writes?|is called|stands? for|means|notation|syntax|format string|in a template|in a shell|template engine|"
    r"double braces|the name|the mark|has one|variable|placeholders?|chẳng hạn|ví dụ|gọi là|nghĩa là \"|viết là|ký hiệu|kí hiệu|cú pháp|biến số|dùng để chỉ)\b",
    re.IGNORECASE,
)
#: Words of a line that explains, for each place in it.
DENSITY = 4
CODE = re.compile(r"```.*?(?:```|\Z)|`[^`\n]+`|<(pre|code)>.*?</\1>", re.DOTALL)


def messages(low: str) -> Iterator[re.Match]:
    """The page's own sentences of a lower-cased text, each from where it starts."""
    for family in FAMILIES:
        if any(w in low for w in family.needs):
            for start in STARTS.finditer(low):
                if m := family.grammar.match(low, start.end()):
                    yield m


def places(text: str) -> Iterator[re.Match]:
    """The unfilled places in their order."""
    at = 0
    while start := _PLACE_STARTS.search(text, at):
        m = PLACES.match(text, start.start())
        if m:
            yield m
        at = m.end() if m else start.end()


def _line(text: str, at: int) -> tuple[str, int]:
    start = text.rfind("\n", 0, at) + 1
    end = text.find("\n", at)
    return text[start : len(text) if end < 0 else end], at - start


def _quoted(line: str, at: int) -> bool:
    before = line[:at]
    return before.count('"') % 2 == 1 or before.count("“") > before.count("”") or before.count("«") > before.count("»")


def _translated(line: str, start: int, end: int) -> bool:
    """Whether the message is one side of a pair of a sentence and its translation."""
    for m in re.finditer(r"(?<=[.!?\"”…])\s+[-–—=|+]\s+|\t|(?<=\w)\s+[-–—=|]\s+(?=\S[^\n]*[.!?]?$)", line):
        other = line[m.end() :] if m.start() >= end else line[: m.start()] if m.end() <= start else ""
        other = other.strip(" -*=+•")
        if len(re.findall(r"[^\W\d_]+", other)) >= 2 and not any(places(other)):
            # the message itself may hold a dash ("HTTP 404 - Not Found")
            if not re.match(rf"{_REASON}[.!]?$", other, re.IGNORECASE):
                return True
    return False


def residue(text: str | None) -> str | None:
    """What kind of residue a text holds (``place``, ``message`` or ``filler``), or null."""
    if not text:
        return None
    if HARD.search(text):
        text = unicodedata.normalize("NFC", text)
        text = consistent(text) if HARD.search(text) else text
    text = re.sub(r"\r\n?", "\n", text)
    text = CODE.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)
    low = text.lower()
    for m in messages(low):
        line, at = _line(low, m.start())
        if DEFINITION.match(line) or _quoted(line, at) or _translated(line, at, at + len(m[0].split("\n")[0])):
            continue
        return "message"
    if (_NUMBER_ENDS.search(low) and NUMBERED.search(low)) or MASH.search(text):
        return "filler"
    row = low
    for sign in "-–,.":
        row = row.replace(sign, " ")
    row = row.split()
    for m in REPEAT.finditer(low) if any(map(eq, row, row[1:])) else ():
        if m[1].isdigit() or len(m[1]) > 5 and len(m[0]) < 8 * len(m[1]):
            continue
        line, at = _line(low, m.start())
        if not DEFINITION.match(line) and not _quoted(line, at):
            return "filler"
    for middle in mock_latin(low):
        line, at = _line(low, middle)
        if not DEFINITION.match(line) and not _quoted(line, at):
            return "filler"
    remarks = []
    for m in places(text):
        line, at = _line(text, m.start())
        if DEFINITION.match(line) or _quoted(line, at):
            continue
        filled, n = PLACES.subn(" ", line)
        if EXPLAINS.search(filled) and n * DENSITY < len(line.split()):
            continue
        name = m[0][1:-1]
        if _REMARK.search(m[0]) and not (_ORDER.match(m[0]) or " " in name and (name.isupper() or name.istitle())):
            remarks.append(bool(_LACKS.search(line[:at])))
            continue
        return "place"
    return "place" if any(remarks) else None


@F.pandas_udf(T.StringType())
def _residue_udf(texts: pd.Series) -> pd.Series:
    return texts.map(residue, na_action="ignore")


_residue_once = _residue_udf.asNondeterministic()


def residue_texts(documents: DataFrame) -> DataFrame:
    """``(doc_id, kind)`` of the documents that hold residue, wholly or in part.

    Null and empty texts hold none. Repeated rows come out as often as they came in.
    Texts are read whole, whatever their length.
    """
    some = spread(documents.select("doc_id", "text")).filter(F.length("text") > 0)
    return some.select("doc_id", _residue_once("text").alias("kind")).filter(F.col("kind").isNotNull())


def clean_texts(documents: DataFrame) -> DataFrame:
    """The documents without residue, all their columns kept."""
    checked = documents.withColumn("_kind", _residue_once("text"))
    return checked.filter(F.col("_kind").isNull()).drop("_kind")
