"""Problem 2: broken pairs of a question and its answer.

Method, by defect, in the order in which a pair gets at most one:
empty: nothing but white space, invisible characters and markup remains of the answer.
copy: the question's suffix automaton is traversed by the answer; spans of the answer that repeat most of the question are
copied, and a copy holds little else than a lead-in before them.
refusal: an automaton of refusing phrases finds the sentences that decline; the answer only declines if its other
sentences are courtesies, or only restate the question's topic.
language: votes of stopwords, letters and scripts for the question's and the answer's language differ clearly, and the
question doesn't ask for another language.
truncated: a stack of delimiters (code fences; brackets and quotes of the whole answer) isn't empty at the end, or the last line breaks off: prose
without an end, a list item without the end its siblings have, a table row without its border, a value without its
decimals, or fewer list items than announced.

Defined results: pairs whose question is null or blank aren't judged (of several questions, the blank ones); a null answer
is empty; a pair delivered again counts once; very long texts are judged whole.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorespan.session import spread

#: Share of a question that a copied span repeats, and what else a copy may hold: a lead-in of so many letters, or this share.
COPIED, LEAD_IN, LEAD_SHARE = 0.85, 28, 0.2

#: Phrases by which an answer declines, lower case.
REFUSALS = (
    "i can't help with", "i cannot help with", "i can't assist", "i cannot assist", "can't answer", "cannot answer", "not something i can assist", "not able to answer", "unable to answer",
    "must decline", "have to decline", "request cannot be fulfilled", "not have enough information to answer", "no relevant content was found", "so i cannot reply", "unable to find anything on this",
    "outside what i am allowed", "rather not comment", "not allowed to discuss", "not permitted to discuss", "can't discuss", "cannot discuss",
    "无法回答", "无法作答", "不能回答", "帮不了您", "没有可以参考的资料", "没有在知识库中查找到", "超出了我的服务范围", "不能提供关于", "不便评论", "无法提供帮助", "不便回答",
    "kann ich leider nicht helfen", "das kann ich nicht beantworten", "liegen mir keine informationen vor", "muss ich ablehnen", "darf ich zu", "keine auskunft geben", "nicht beantworten kann",
    "je ne peux pas répondre", "je n’ai trouvé aucune information", "je n'ai trouvé aucune information", "préfère ne pas me prononcer", "sort de mon périmètre", "pas autorisé à parler", "je ne peux pas vous aider", "dois refuser cette demande",
    "no puedo ayudarle", "no puedo responder", "no estoy autorizado", "queda fuera de mi alcance", "debo rechazar esta solicitud", "no dispongo de información suficiente", "no he encontrado información", "no he encontrado ninguna información", "prefiero no opinar", "no se ha encontrado",
    "não posso ajudar", "não posso responder", "não tenho permissão para falar", "preciso recusar este pedido", "não encontrei nenhuma informação", "fora do meu alcance", "prefiro não comentar", "não tenho informação suficiente", "não disponho de informação",
    "не могу ответить", "не могу помочь", "помочь не могу", "придётся отклонить", "не вправе обсуждать", "ничего не найдено", "не могу комментировать", "вне моей компетенции", "выходит за рамки", "недостаточно информации", "предпочту не",
    "お答えできません", "対応いたしかねます", "お話しできません", "回答を控えます", "お役に立てません", "お手伝いできません", "情報が見つからない", "対象外です",
)
#: Courtesies that add nothing to a refusal, lower case.
COURTESIES = (
    "sorry", "apologies", "apologise", "apologize", "thank you", "thanks", "is there anything else", "ask a colleague", "i see that you would like to know", "please contact", "please ask", "unfortunately", "let me know",
    "抱歉", "对不起", "不好意思", "很遗憾", "感谢您", "谢谢", "您想了解", "您还有", "还有其他", "请联系", "建议咨询", "请咨询", "请换个问题", "您好",
    "es tut mir leid", "entschuldig", "danke", "vielen dank", "kann ich sonst", "haben sie noch", "bitte fragen sie", "sie möchten", "bitte wenden", "sie fragen nach", "sie interessieren sich", "gern",
    "désolé", "merci", "excusez", "avez-vous", "puis-je vous aider", "vous souhaitez", "veuillez contacter", "vous demandez", "malheureusement", "vous voulez", "autre chose",
    "lo siento", "gracias", "perdone", "disculpe", "necesita algo más", "quiere saber", "usted desea", "consulte con", "por favor", "le interesa", "desea", "algo más",
    "desculpe", "obrigad", "lamento", "precisa de mais", "deseja saber", "infelizmente", "fale com", "contacte", "gostaria de saber", "quer saber", "mais alguma coisa",
    "к сожалению", "спасибо", "извините", "простите", "чем ещё", "вы хотите узнать", "обратитесь", "вас интересует", "что-нибудь ещё", "вы спрашиваете",
    "申し訳", "恐れ入ります", "ありがとうございます", "すみません", "お問い合わせ", "ほかに", "他に", "ご質問",
)
#: Words by which a question asks for a language, lower case.
ASKS_LANGUAGE = re.compile(
    r"\b(?:in|into) (?:english|german|french|spanish|portuguese|russian|chinese|japanese)\b|译成|(?:用|成|为)(?:英|中|德|法|西班牙|葡萄牙|俄|日|汉)(?:语|文)|(?:英|中国|ドイツ|フランス|スペイン|ポルトガル|ロシア|日本)語(?:に|で)"
    r"|\bauf (?:englisch|deutsch|französisch|spanisch|portugiesisch|russisch|chinesisch|japanisch)|\bins (?:englische|deutsche|französische|spanische|portugiesische|russische|chinesische|japanische)"
    r"|\ben (?:anglais|allemand|français|espagnol|portugais|russe|chinois|japonais)\b|\b(?:en|al) (?:inglés|alemán|francés|español|portugués|ruso|chino|japonés)\b"
    r"|\b(?:em|para o?) ?(?:inglês|alemão|francês|espanhol|português|russo|chinês|japonês)\b|по-(?:английски|немецки|французски|испански|португальски|русски|китайски|японски)|на (?:английск|немецк|французск|испанск|португальск|русск|китайск|японск)"
)
#: Stopwords of the languages in Latin letters.
STOPWORDS = {
    "en": "the and of to in is that for on with as are this it by be at from or an how do i does can where what when who why my which not until its has have was were will your you they then so",
    "de": "der die das und ist nicht mit den dem des ein eine einen auf für zu im von sich wie wo wer was wenn ob ich es sie auch bei bis nach vor aus an am wird werden dass damit zum zur als",
    "fr": "le la les des et est une un dans que pour sur qui pas avec au aux du de ce cette il elle je où comment quand lorsque pourquoi sans sauf puis par mon son ses leur ne se vous votre",
    "es": "el la los las de y que en un una es por con para del al se no su sus como cómo cuando cuándo dónde qué quién puedo mi hay sin más pero si este esta está después salvo hasta",
    "pt": "o a os as de e que em um uma é por com para do da dos das no na nos nas se não seu sua como quando onde quem posso minha mais sem mas ao à até quanto isto depois exceto pelo",
}
_STOP = {w: [l for l, ws in STOPWORDS.items() if w in ws.split()] for ws in STOPWORDS.values() for w in ws.split()}
_LETTER_CLUES = {"ñ": "es", "¿": "es", "¡": "es", "ã": "pt", "õ": "pt", "ß": "de", "ä": "de", "ö": "de", "ü": "de", "œ": "fr", "è": "fr", "ù": "fr", "î": "fr", "ô": "fr", "ê": "fr"}
#: Nouns that announce a list of a given length, lower case.
_ANNOUNCED = r"steps?|points?|items?|schritten?|punkte[n]?|étapes?|pasos?|puntos?|passos?|pontos?|шаг\w*|пункт\w*|步骤|步|点|手順|項目"
_ANNOUNCE = re.compile(rf"(?<![\d.,])(\d{{1,3}})\s*(?:个|项|つの|つ|か所の?)?\s*(?:{_ANNOUNCED})(?!\w*\d)|(?:{_ANNOUNCED})\s*[:：]?\s*[(（](\d{{1,3}})[)）]|(?:{_ANNOUNCED})は(\d{{1,3}})つ")

_TAG = re.compile(r"</?[a-zA-Z][^<>]*>|<!--.*?-->|&(?:[a-zA-Z]+|#\d+|#x[0-9a-fA-F]+);", re.S)
_IMAGE = re.compile(r"!?\[\s*\]\(\s*\)")
_INVISIBLE = re.compile(r"[\s ­؜ᅟᅠ᠎ -‏ -  -⁯　ㅤ︀-️﻿]|[*_#>`~|\\\-=+]")
_NOT_LETTER = re.compile(r"[\W_]+")
_SENTENCE = re.compile(r"[^.!?。！？\n]+(?:[.!?。！？]+(?=\s|$|[^\x00-˿])|[。！？]|\n|$|[.!?])")
_END = re.compile(r"[.!?。！？…][\s*_~\"'»”’)）\]】」』>]*$|(?:\U0001F300-\U0001FAFF)$")
_URL = re.compile(r"https?://\S+$|www\.\S+$")
_BULLET = re.compile(r"^\s*(?:[-*•+–]|(\d{1,3})[.)、])\s*(.*)$")
_CUT_VALUE = re.compile(r"(?:^|[\s为到を])0[.,，]$|(?:version|versión|versão|версии|バージョン)\s*\d+[.,]$|[、，,;:：；(（\[「『“‘=/–—]$", re.I)
_OPEN = {"(": ")", "（": "）", "[": "]", "「": "」", "『": "』", "“": "”", "„": "“", "«": "»", "【": "】", "{": "}"}
_BRACKETS = set(")）]】}")
_CODE = re.compile(r"```.*?(?:```|$)|`[^`\n]*`", re.S)


def is_empty(answer: str | None) -> bool:
    return not answer or not _INVISIBLE.sub("", _IMAGE.sub("", _TAG.sub("", answer)))


def letters(text: str) -> str:
    return _NOT_LETTER.sub("", _TAG.sub(" ", text).casefold())


class SuffixAutomaton:
    """All substrings of a text; run() gives, for each place of another text, the longest substring that ends there."""

    def __init__(self, text: str) -> None:
        self.next: list[dict[str, int]] = [{}]
        self.link, self.len = [-1], [0]
        last = 0
        for c in text:
            cur = len(self.len)
            self.next.append({})
            self.len.append(self.len[last] + 1)
            self.link.append(0)
            p = last
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = cur
                p = self.link[p]
            if p >= 0:
                q = self.next[p][c]
                if self.len[p] + 1 == self.len[q]:
                    self.link[cur] = q
                else:
                    clone = len(self.len)
                    self.next.append(dict(self.next[q]))
                    self.len.append(self.len[p] + 1)
                    self.link.append(self.link[q])
                    while p >= 0 and self.next[p].get(c) == q:
                        self.next[p][c] = clone
                        p = self.link[p]
                    self.link[q] = self.link[cur] = clone
            last = cur

    def run(self, text: str) -> list[int]:
        out, state, size = [], 0, 0
        for c in text:
            while state and c not in self.next[state]:
                state = self.link[state]
                size = self.len[state]
            if c in self.next[state]:
                state = self.next[state][c]
                size += 1
            out.append(size)
        return out


def is_copy(questions: list[str], answer: str) -> bool:
    a = letters(answer)
    if not a:
        return False
    for question in questions:
        q = letters(question)
        if len(q) < 4 or len(a) < COPIED * len(q):
            continue
        sizes = SuffixAutomaton(q).run(a)
        least, i, copied, first = max(4, COPIED * len(q)), len(a) - 1, 0, len(a)
        while i >= 0:
            if sizes[i] >= least:
                copied += sizes[i]
                i -= sizes[i]
                first = i + 1
            else:
                i -= 1
        rest = len(a) - copied
        wide = sum(c > "⺀" for c in a) > len(a) / 2
        if copied and rest <= max(LEAD_IN / 2 if wide else LEAD_IN, LEAD_SHARE * len(a)) and rest - first <= 2:
            return True
    return False


def sentences(text: str) -> list[str]:
    return [s for m in _SENTENCE.finditer(text) if _NOT_LETTER.sub("", s := m[0].strip())]


class Refusals:
    _held: Refusals | None = None

    @classmethod
    def get(cls) -> Refusals:
        cls._held = cls._held or cls()
        return cls._held

    def __init__(self) -> None:
        import ahocorasick

        self.find = ahocorasick.Automaton()
        for kind, phrases in ((1, REFUSALS), (0, COURTESIES)):
            for p in phrases:
                self.find.add_word(p, kind)
        self.find.make_automaton()

    def only_declines(self, questions: list[str], answer: str) -> bool:
        kinds = [(s, {k for _, k in self.find.iter(s.casefold().replace("’", "'"))} | {k for _, k in self.find.iter(s.casefold())}) for s in sentences(_TAG.sub(" ", answer))]
        if not any(1 in k for _, k in kinds):
            return False
        rest = [s for s, k in kinds if not k]
        if not rest:
            return True
        # a sentence that only names the topic: short, and mostly words of the question
        autos = [SuffixAutomaton(letters(q)) for q in questions]
        for s in rest:
            x = letters(s)
            wide = sum(c > "⺀" for c in x) > len(x) / 2
            hit = max((sum(n >= (2 if wide else 5) for n in auto.run(x)) for auto in autos), default=0)
            if len(x) > (40 if wide else 110) or hit < 0.4 * len(x):
                return False
        return True


def language(text: str) -> tuple[str | None, float]:
    """Language by votes and how clear they are: winner's less the next one's, as a share of all, times their number."""
    t = _TAG.sub(" ", re.sub(r"```.*?(?:```|$)|https?://\S+", " ", text, flags=re.S))
    kana = sum("ぁ" <= c <= "ヿ" for c in t)
    han = sum("一" <= c <= "鿿" for c in t)
    cyr = sum("Ѐ" <= c <= "ӿ" for c in t)
    words = re.findall(r"[^\W\d_]+", t)
    latin = [w for w in words if w[0] < "ɐ"]
    latin_letters = sum(map(len, latin))
    size = {"ja": (kana + han) * 2.5 if kana * 8 >= han and kana > 1 else 0.0, "zh": han * 2.5 if kana * 8 < han or kana <= 1 else 0.0, "ru": float(cyr)}
    votes: Counter = Counter()
    low = [w.lower() for w in latin]
    for w in low:
        for l in (of := _STOP.get(w, [])):
            votes[l] += 1 / len(of)
    for c in t.lower():
        if c in _LETTER_CLUES:
            votes[_LETTER_CLUES[c]] += 0.7
    # names are in Latin letters in every language, so letters count only as far as stopwords back them
    backed = min(latin_letters, 12 * sum(votes.values()))
    script, most = max(size.items(), key=lambda x: x[1])
    if most > backed and most >= 6:
        return script, most
    if not votes:
        return None, 0.0
    ranked = votes.most_common(2)
    lead = ranked[0][1] - (ranked[1][1] if len(ranked) > 1 else 0)
    return ranked[0][0], 6 * lead


def other_language(questions: list[str], answer: str) -> bool:
    if any(ASKS_LANGUAGE.search(q.lower()) for q in questions):
        return False
    a, clear = language(answer)
    if a is None or clear < 14:
        return False
    asked = [language(q) for q in questions]
    known = {l for l, c in asked if l and c >= 5}
    return bool(known) and a not in {l for l, _ in asked}


def is_truncated(answer: str) -> bool:
    text = answer.rstrip().rstrip("​﻿").rstrip()
    lines = text.split("\n")
    fences = sum(line.lstrip().startswith("```") for line in lines)
    if fences % 2:
        return True
    if open_delimiters(text):
        return True
    last = lines[-1].strip()
    if last.startswith("```"):
        return False
    if _announced_more(lines):
        return True
    rows = [i for i, line in enumerate(lines) if line.strip().startswith("|")]
    if rows and rows[-1] == len(lines) - 1:
        if not last.endswith("|") or last == "|":
            return True
        return len(rows) > 1 and last.count("|") != lines[rows[-2]].count("|") and rows[-2] == len(lines) - 2
    if re.fullmatch(r"(?:[-*•+]|\d{1,3}[.)、]?)", last):
        return len(lines) > 1
    if _URL.search(last):
        return False
    if item := _BULLET.match(lines[-1]):
        if _END.search(last):
            return bool(_CUT_VALUE.search(last))
        siblings = []
        for line in reversed(lines[:-1]):
            m = _BULLET.match(line)
            if not m or bool(m[1]) != bool(item[1]):
                break
            siblings.append(bool(_END.search(line.strip())))
        # an item breaks off if its siblings end like sentences; lone numbered items are steps, and these do
        return sum(siblings) * 2 > len(siblings) if siblings else bool(item[1])
    if _CUT_VALUE.search(last):
        return True
    if _END.search(last):
        return bool(re.search(r"[぀-鿿][^.\n]{0,12}\d\.$", last))
    x = letters(last)
    return len(x) >= 2 and bool(re.search(r"\s", last) or re.search(r"[぀-鿿]{2}", last) or len(lines) > 1)


def open_delimiters(text: str) -> list[str]:
    """The closing marks still wanted at the end of a text, code left out. A mark that closes nothing is no delimiter, nor
    is one after a digit that may be a unit. A blank line ends what quotes are open, as they may go on by paragraph."""
    stack: list[str] = []
    before = ""
    for c in _CODE.sub(" ", text):
        if stack and c == stack[-1]:
            stack.pop()
        elif c in _OPEN:
            stack.append(_OPEN[c])
        elif c == '"' and not before.isdigit() and not before.isalpha():
            stack.append('"')
        elif c == "\n" and before == "\n":
            stack = [x for x in stack if x in _BRACKETS]
        elif c in _BRACKETS and c in stack:
            # what was opened inside of a closed bracket is over
            del stack[len(stack) - 1 - stack[::-1].index(c) :]
        before = c
    return stack


def _announced_more(lines: list[str]) -> bool:
    for i, line in enumerate(lines):
        if _BULLET.match(line) and not line[:1].isalpha():
            continue
        for m in _ANNOUNCE.finditer(line.lower()):
            want = int(m[1] or m[2] or m[3])
            if not 2 <= want <= 100:
                continue
            n = j = 0
            for after in lines[i + 1 :]:
                if not after.strip() or after.startswith((" ", "\t")) and not _BULLET.match(after):
                    continue
                if not _BULLET.match(after):
                    break
                n += 1
            # only a line right before a list, or an announcement at the very end, speaks of one
            j = i == len(lines) - 1 and line.rstrip().endswith((":", "："))
            if (0 < n < want) or j:
                return True
    return False


def defect(questions: list[str | None] | None, answer: str | None) -> str | None:
    asked = [q for q in questions or [] if q and not is_blank(q)]
    if not asked:
        return None
    if is_empty(answer):
        return "empty"
    if is_copy(asked, answer):
        return "copy"
    if Refusals.get().only_declines(asked, answer):
        return "refusal"
    if other_language(asked, answer):
        return "language"
    return "truncated" if is_truncated(answer) else None


def is_blank(text: str) -> bool:
    return not re.sub(r"[\s​-‏⁠﻿ 　]", "", text)


def pairs_of(chat_record: DataFrame, paragraph: DataFrame) -> DataFrame:
    """item_table, item_id, questions, answer."""
    a = chat_record.select(F.lit("application_chat_record").alias("item_table"), F.col("id").alias("item_id"), F.array("message").alias("questions"), F.col("answer_text").alias("answer"))
    questions = F.transform(F.col("problem_list"), lambda x: x["content"])
    b = paragraph.where(F.size("problem_list") > 0).select(F.lit("paragraph").alias("item_table"), F.col("id").alias("item_id"), questions.alias("questions"), F.col("content").alias("answer"))
    return a.unionByName(b).where(F.col("item_id").isNotNull() & F.exists("questions", lambda x: F.trim(x) != ""))


def defects(pairs: DataFrame) -> DataFrame:
    """item_table, item_id, defect of each broken pair, once."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = [(t, i, d) for t, i, q, a in f.itertuples(index=False) if (d := defect(q if q is None else list(q), a))]
            yield pd.DataFrame(out, columns=["item_table", "item_id", "defect"])

    return spread(pairs).mapInPandas(run, "item_table string, item_id string, defect string").dropDuplicates(["item_table", "item_id"])
