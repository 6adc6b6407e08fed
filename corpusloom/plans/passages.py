"""Generated Chinese text for the queries: the tables hold no ideographs.

Every document gets four lines before its own text, one of each list, chosen by its id; as the lengths of the lists
have no common factor, the lines combine in some hundred thousand ways. spark() and sql() give the same text.
"""

from __future__ import annotations

WORDING = """總的來說，這個程式認得設定。|说白了，服务掛了。|賦能業務，形成閉環；就行。|我們沒跑完測試，明天再跑一次。|他在跑步，不必再跑道外。|把套件装上了，安裝上游版本。
如果要更新的話，先備份。|通過設定檔案的方式調整。|已進行同步，并进行了下载。|對這個目錄進行檢查。|被使用者所發現的問題。|存在著問題，也存在着风险。|清單 一份 在桌面上。
大幅改寫後顯著提升效能。|效能顯著提升了 30%。|極大地改善體驗，没有数字。|選擇「設定」頁面。|在當今資訊快速流動的時代，文件很多。|本文將介紹安裝步驟。|系統變得更加智慧。|點擊此處下載。
正在下載檔案中。|發生了一個錯誤。|確定要這麼做？|跑的很快，寫得很好。|快速的執行檢查。|認真地態度。|眾所周知，抓手很多，顆粒度不夠。|搞定！这个一大堆。|踩坑与填坑都記下。
無縫銜接與一站式體驗。|抱歉，哎呀，糟糕了。|不难发现，打通壁垒不易。|一句普通的說明。|另一句没有問題的话。|它會覺得慢，自己跑去休息。|小白也能整活。|弄好了就行，白忙一场。|程序认得路径。|开启全新篇章。|赋能与闭环。"""
TYPOGRAPHY = """使用Python３．５，，寫完。|全形ＡＢＣ與０１２。|版本 ３．１４ 已發布。|真的。。。好！！|等一下...再說|wait... for it|這裡--那裡|plain -- dash|a--b 與 c|中文abc混排|中 文 與 abc 分開
一切正常。|省略……沒問題|破折——沒問題|值是５。|，，開頭|結尾、、|問？？答|行內 1．5 公尺|半形,逗號|半形. 句號|好:壞|對;錯|嗎?是的|好!對|数字12个|第3章|文字 A 文字|純中文|....四點中文|-- 中文"""
TERMS = """預設值是默认。|網路与网络。|軟體和软件，神经网络。|類神經網路使用網路。|記憶體|内存不足|原始碼與源碼|源代码|查詢|查询|token 令牌要保密。|Tokens 與權杖|令牌|pull request 就是拉取請求|拉取请求|正體中文與简体字|zh-CN 說软件，zh-TW 說軟體
對照：网络 網路|繁體中文說明|公里与英里|皇后|为何应用|為何應用|程式碼與代码|代碼|裡面和裏面|裡面|文件与檔案|檔案"""
OTHER = """😀 完成|✓ 完成|☀️ 天氣|1️⃣ 第一步|⭐ 星|無符號|# Generated with an AI assistant|Written by: a chatbot|Co-authored-by: helper bot <b@x.org>|Generated by hand|Signed-off-by: A <a@users.noreply.example.org>|Signed-off-by: B <b@example.org>
測試全部通過|All tests passed|checks: green|tests fail|本次提交包含修正|所有工作完成|我們新增欄位|他說，我會修改|本次修改包括三項|他修改了|普通一行"""


def _list(x: str) -> list[str]:
    return [f for line in x.split("\n") for f in line.split("|")]


SLOTS = [(_list(x), factor) for x, factor in ((WORDING, 7), (TYPOGRAPHY, 11), (TERMS, 5), (OTHER, 3))]


def _chosen(place: str, fragments: list[str], factor: int, dialect: str, key: str) -> str:
    quoted = ", ".join("'" + f.replace("'", "''") + "'" for f in fragments)
    index = f"CAST(({key} * {factor}) % {len(fragments)} AS INT) + 1"
    return f"element_at(array({quoted}), {index})" if dialect == "spark" else f"list_extract([{quoted}], {index})"


def lines(dialect: str, key: str = "doc_id") -> str:
    """The four lines, ended by a line feed each."""
    return "concat(" + ", ".join(f"{_chosen('', f, k, dialect, key)}, chr(10)" for f, k in SLOTS) + ")"
