"""Defective prompt and reply pairs, each with the kind of its defect.

    empty      nothing but blanks, marks, markup or an empty value
    copy       a suffix automaton of the prompt covers the reply: case, punctuation and layout are folded
               away, then the share of the reply inside long common factors is measured
    refusal    a refusal automaton (phrases over words, of several languages) accepts sentences, wherever they
               stand and quoted speech put aside, that make up a share of what is said
    truncated  a stack of delimiters (brackets, strings, fences) is not empty at the end, or prose stops
               without the end of a sentence, list item or label
    language   votes of stopwords and scripts for the prose of the reply and of the prompt disagree

The first that holds, in this order, is the defect. A reply inside JSON, fenced or not, is judged by its
string values. A bare status code is an answer.

Defined cases: a null prompt leaves copy and language unjudged; a null reply is empty; replies with a tool
call are no pairs (null elements of the list are no calls); pairs delivered twice come out once; results
whose response is unknown are judged without prompt; very long texts are read whole, in linear time.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm.automata import PhraseAutomaton, SuffixAutomaton
from siftwell.storage import spread

#: A common factor counts from so many folded characters on; so much of the reply makes a copy.
COPY_FACTOR, COPY_SHARE = 10, 0.85

# Frequent function words by language. A word of one language alone has a whole vote, others little.
STOPWORDS = {
    "en": "the of and to in is that it for on with as this but not are was be or from by at an which has have its does before after any what when only nothing every would there if since because into you your reviews our we they their them these those so than such more most no all each two three never who how also while yet my he she us may can would should",
    "de": "der die das und ist nicht ein eine einer den dem des von mit auf im zu wird werden sich auch als für aus bei nach nur daher ohne jede diese dieser dieses vor wie oder kein keine sind durch damit dass weil ob woher welche läuft unsere unser unserer jeder jedem jeden nie bevor bis ihn ihm ihr wir sie es er man kann muss soll hat haben war waren worden dessen deren welcher alle allen zwei drei danach davon dafür bereits bitte hier sehr wenn zu sein mit ihre",
    "fr": "le la les des et est une un du dans que qui pour pas sur par avec au aux ce cette ces il elle sans donc ne sont plus avant après comme été a son sa ses ou car quel quelle vers peut rien notre votre nous vous leur leurs même chaque aucun aucune lorsque dont déjà trop tard ici être avoir fait doit ainsi seulement tous toutes deux trois qu nos vos si ni cela jamais toujours aux mes je cette alors",
    "es": "el la los las y es una un del en que para por con no se su al lo como más sin antes después así pero este esta estos nadie luego dos tres solo de puede qué cual muy entre sobre cada ningún cada ninguna nuestro nuestra nuestros otro otra sido ser está están fue hay hasta desde donde porque cuando tan también todo todos todas sólo sus le les nos misma mismo quien ha han mi mis yo ya qué ni",
    "pt": "o a os as e é uma um do da em que para por com não se na no ao mais sem antes depois assim mas este esta dos das pelo pela ninguém foi seu sua às qualquer risco nenhuma nenhum apenas são até seus suas nos nas pelos pelas você isso está todos ela ele eles nem nosso nossa três dois quando sempre nunca esse essa há",
    "it": "il lo la gli le e è una un di del della in che per con non si al come più senza prima dopo ma questo questa dei delle nel nella sono alla ogni nessun nessuno perché anche dove quando già ha hanno stato degli dagli dal dalla nelle loro suo sua solo due tre ci",
    "ru": "и в во не на с со по для что это как к у из за от до же при без его её их так только уже или но а ещё если нет то все этот эта эти который которая",
    "nl": "de het een en is niet van met op in te wordt zich ook als voor uit bij naar alleen zonder deze dit die dat geen zijn door aan maar of dan nog wel worden werd heeft hebben onze hun wij zij nooit altijd drie twee elke iedere na tot over onder",
}
_VOTES: dict[str, list[str]] = {}
for _lang, _words in STOPWORDS.items():
    for _word in dict.fromkeys(_words.split()):
        _VOTES.setdefault(_word, []).append(_lang)
# Spellings of one language among those with Latin letters.
_SPELLING = (("es", re.compile("ción$|ciones$|sión$|ñ|ería$|aría$")), ("pt", re.compile("ção$|ções$|ão$|õ")), ("de", re.compile("[ßäöü]")), ("fr", re.compile("[èùûœî]|é[es]?$")))
_WEIGHT = {1: 1.0, 2: 0.25, 3: 0.1}

_HELP = "help|assist|answer|comment|discuss|talk|speak|go|fulfil|fulfill|comply|continue|provide|respond|share|engage|say|judge|assess|evaluate|review|analyse|analyze|do"
_HELFEN = "helfen|weiterhelfen|beantworten|bewerten|beurteilen|einschätzen|sprechen|äußern|reden|antworten|eingehen|fortfahren|kommentieren"
_AIDER = "aider|répondre|parler|traiter|continuer|commenter|évaluer|juger|discuter|analyser"
_AYUDAR = "ayudar|ayudarle|ayudarte|responder|comentar|hablar|continuar|evaluar|juzgar|tratar|opinar|analizar"
#: Phrases by which a reply declines, per language, for ``PhraseAutomaton``. The one who declines is the writer: what
#: code refuses, rejects or cannot do is no refusal.
REFUSALS = (
    f"i|we ~2 can't|cannot|won't|couldn't|wouldn't ~3 {_HELP}", f"i|we ~2 can|will|could|would|may|am|are|do not ~3 {_HELP}", f"i'm|we're not|unable ~3 {_HELP}", f"i'll|we'll not ~2 {_HELP}", f"i|we ~2 unable ~2 {_HELP}",
    "i|we ~2 must|have|need ~1 decline|refuse|pass|leave|stop", "i|we decline|refuse to", "i|we|i'd|we'd ~1 rather|prefer not", "i|we|i'd|we'd ~1 rather|prefer ~1 stop|leave", "i|we have no opinion|comment|answer",
    "against my|our policy|policies|guidelines|rules|principles", "my|our guidelines|policy|policies|rules|instructions ~3 allow|permit|let|prevent|forbid|prohibit|stop|keep",
    "break|breaks|breaking|violate|violates|violating ~1 rules|guidelines|policy|policies ~1 i|we", "break|breaks|breaking|violate|violates|violating my|our rules|guidelines|policy|policies",
    "outside|beyond ~1 what i|we ~1 can|may|am|are|will", "not something i|we ~1 can|may|will|am|are", "request ~1 denied|refused|rejected|declined ~1 safety|policy|security reasons",
    "no assessment|answer|comment|opinion|analysis|verdict|statement|judgement|judgment ~1 will|can|may be given|provided|made|offered", "let us|me talk|speak about ~5 instead", "talk|speak about something else",
    f"kann|darf|werde|möchte|will ich|wir ~4 nicht ~2 {_HELFEN}", f"ich|wir kann|darf|werde|möchte|können|dürfen|werden ~4 nicht ~2 {_HELFEN}", f"nicht {_HELFEN} kann|darf|werde|möchte",
    "keine auskunft|antwort|bewertung|einschätzung|stellungnahme ~2 geben|abgeben|erteilen|möglich", "muss|möchte ich|wir ~3 ablehnen|verweigern|passen", "ablehnen|verweigern muss|möchte", "meine|unsere richtlinien|regeln|vorgaben ~1 lassen|erlauben|verbieten|untersagen|gestatten",
    f"je|nous ne ~1 peux|puis|pouvons|souhaite|veux ~3 {_AIDER}", "dois|devons|faut refuser|décliner", f"m'est impossible de|d' ~2 {_AIDER}", f"impossible de ~1 {_AIDER}", "préfère|préférons ne pas", "m'interdit|m'interdisent", "m'est ~1 interdit|fermé|défendu", "pas autorisé|autorisée à",
    "aucune réponse|évaluation|analyse|appréciation ~2 donnée|fournie|rendue",
    f"no puedo|podemos|debo|quiero|voy ~2 {_AYUDAR}", "debo|debemos|tengo ~1 rechazar|declinar|negarme", "fuera de lo que puedo|podemos", "no me está permitido", "prefiero|preferimos no", "mis|nuestras normas|reglas|políticas|directrices ~1 impiden|prohíben|permiten", "me impiden",
    "no daré|ofrezco", "no se dará",
)
_REFUSAL = PhraseAutomaton(REFUSALS)
_SAID = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
#: A reply declines if sentences that do so hold this share of its words: what else it says is then courtesy.
REFUSAL_SHARE = 0.2
_QUOTED = re.compile(r"\"[^\"\n]{3,}\"|“[^”\n]{3,}”|«[^»\n]{3,}»|„[^“\n]{3,}“")
_FENCE = re.compile(r"^\s*```[\w+-]*[ \t]*\n?|\n?[ \t]*```\s*$")
_ASKED = re.compile(r"(?i)^\W*(?:question|prompt|q|task|frage|aufgabe|tâche|pregunta|tarea)\s*:")
_CODE = re.compile(r"```.*?(?:```|\Z)|`[^`\n]*`|\b[\w/.-]+\.(?:java|py|js|ts|html|json|ya?ml)\b(?::\d+)?|^\s*\[[^\]\n]*\]\s*$|\b\w+_\w+\b|\b[a-z]+[A-Z]\w*\b", re.S | re.M)
_EMPTY_VALUE = re.compile(r"(?i)^(?:null|none|nil|undefined|nan|n/?a|empty|keine|\W|_)*$")
_SIGN = re.compile(r"(?:\w\s?\.\.\.|…|�|[\[(<]\s*(?:\.\.\.|…)?\s*(?:truncated|cut(?: off)?|snip(?:ped)?|shortened|continued|gekürzt|abgeschnitten|tronqué|truncado)\b[^\])>\n]{0,30}[\])>])\s*$", re.I)
_ENDS = re.compile(r"[.!?:;。！？)\]}»”\"'`*>|]$")
#: Last lines that are whole without a mark: list items that end with a number or a file, labels with a value.
_ITEM = re.compile(r"^\s*(?:[-*•+]|\d+[.)])\s+.*(?:\d|\.(?:java|py|js|ts|jsx|tsx|html|json|ya?ml|xml|md|txt|go|rb|c|cpp|h|cs|php|sql|sh))$")
_LABEL = re.compile(r"^\W*\w[\w ]{1,24} ?: ?\W*(?:true_positive|false_positive|needs_review|needs_more_context|true positive|false positive|uncertain|unknown|yes|no|high|medium|low|error|warning|info|\d{3,5})\W*$", re.I)
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+|(?<=[。！？])")
_WORD = re.compile(r"[^\W\d_]+")
_FOREIGN = re.compile("[\u0370-\uffff]")
_SCRIPTS = (("ja", re.compile(r"[\u3040-ヿ]")), ("zh", re.compile(r"[一-鿿]")), ("ru", re.compile(r"[Ѐ-ӿ]")), ("ko", re.compile(r"[가-\ud7af]")), ("ar", re.compile(r"[\u0600-ۿ]")), ("el", re.compile(r"[Ͱ-Ͽ]")))


def language(prose: str, words: dict[str, int] | None = None) -> tuple[str | None, dict[str, float]]:
    """The language most votes are for (None without a clear winner) and the votes. ``words``: counts of those of the lower-case prose, if known."""
    if _FOREIGN.search(prose):
        letters = sum(map(str.isalpha, prose))
        for name, script in _SCRIPTS:
            if letters and len(script.findall(prose)) > (0.1 if name == "ja" else 0.3) * letters:
                return name, {name: 99.0}
    votes: dict[str, float] = {}
    for word, times in (Counter(_WORD.findall(prose.lower())) if words is None else words).items():
        langs = _VOTES.get(word)
        if langs is not None:
            weight = _WEIGHT[min(3, len(langs))] * times
            for lang in langs:
                votes[lang] = votes.get(lang, 0) + weight
        elif not word.isascii():
            for lang, mark in _SPELLING:
                if mark.search(word):
                    votes[lang] = votes.get(lang, 0) + 0.5 * times
    if not votes:
        return None, votes
    ranked = sorted(votes.items(), key=lambda x: -x[1])
    if len(ranked) > 1 and ranked[0][1] < 1.15 * ranked[1][1]:
        return None, votes
    return ranked[0][0], votes


def _strings(value: object) -> Iterator[str]:
    if isinstance(value, str):
        yield value
    elif isinstance(value, dict):
        for key, inner in value.items():
            if str(key).lower() not in ("verdict", "confidence", "status", "severity", "type"):
                yield from _strings(inner)
    elif isinstance(value, list):
        for inner in value:
            yield from _strings(inner)


def open_delimiters(text: str) -> list[str]:
    """The stack of a JSON text at its end: brackets that wait for their partner, a quote inside a string."""
    stack: list[str] = []
    string = escaped = False
    for c in text:
        if string:
            if escaped:
                escaped = False
            elif c == "\\":
                escaped = True
            elif c == '"':
                string = False
        elif c == '"':
            string = True
        elif c in "{[":
            stack.append(c)
        elif c in "}]" and stack:
            stack.pop()
    return stack + ['"'] * string


class _Reply:
    """A reply taken apart: is it JSON, is it closed, and which prose does it carry?"""

    def __init__(self, text: str) -> None:
        self.text = text.strip().strip("\u200b\ufeff\u2060").strip()
        fenced = self.text.startswith("```")
        body = _FENCE.sub("", self.text).strip() if fenced else self.text
        self.json = body[:1] in ("{", "[") and (fenced or bool(re.match(r"[\[{]\s*(?:[\"{\[\]}]|$)", body)))
        self.open = open_delimiters(body) if self.json else []
        self.fence_open = len(re.findall(r"(?m)^\s*(?:> ?)*```", self.text)) % 2 == 1
        self.value: object = None
        self.prose = body
        if self.json:
            try:
                self.value = json.loads(body)
                self.prose = "\n".join(_strings(self.value))
            except ValueError:
                quoted = re.findall(r"\"((?:[^\"\\]|\\.)*)(?:\"(?!\s*:)|\Z)", body)
                self.prose = "\n".join(q for q in quoted if " " in q)
        self.body = body

    @property
    def empty(self) -> bool:
        if _EMPTY_VALUE.match(re.sub(r"```\w*", "", self.text)):
            return not re.search(r"\d", self.text)
        return self.value is not None and not any(isinstance(x, (int, float)) or str(x).strip() for x in _leaves(self.value))

    @property
    def truncated(self) -> bool:
        if re.fullmatch(r"\W*(?:status\W*)?\d{3,5}\W*", self.text, re.I):
            return False
        if _SIGN.search(self.text) or self.open or self.fence_open:
            return True
        if self.json:
            return False
        end = self.body.rstrip().rstrip("*_")
        last = end.rsplit("\n", 1)[-1]
        return not (_ENDS.search(end) or _ITEM.match(last) or _LABEL.match(last))


def _leaves(value: object) -> Iterator[object]:
    if isinstance(value, dict):
        for inner in value.values():
            yield from _leaves(inner)
    elif isinstance(value, list):
        for inner in value:
            yield from _leaves(inner)
    elif value is not None:
        yield value


def _fold(text: str) -> str:
    return "".join(filter(str.isalnum, text.casefold()))


def covered(reply: str, prompt: str) -> float:
    """Share of the folded reply that lies in factors of the prompt of at least COPY_FACTOR characters (the whole prompt, if it is shorter)."""
    if not reply or not prompt:
        return 0.0
    need = min(COPY_FACTOR, len(prompt))
    if need == COPY_FACTOR and len(reply) >= COPY_FACTOR:
        # Every factor of ten characters holds a whole block of five. Of overlapping factors every second one is kept, so
        # blocks count once; each still holds a block per thirteen characters. Fewer blocks than that rule a copy out for sure.
        known = {prompt[i : i + 5] for i in range(len(prompt) - 4)}
        if 26 * sum(reply[i : i + 5] in known for i in range(0, len(reply) - 4, 5)) < COPY_SHARE * len(reply):
            return 0.0
    mark = bytearray(len(reply))
    for end, length in enumerate(SuffixAutomaton.of(prompt).matches(reply)):
        if length >= need:
            mark[end - length + 1 : end + 1] = b"\x01" * length
    return sum(mark) / len(reply)


def refuses(prose: str) -> bool:
    """Do sentences that decline, wherever they stand, make up their share of what is said? Quoted speech is put aside."""
    declining = said = 0
    for sentence in _SENTENCE.split(_QUOTED.sub(" ", prose)):
        words = _SAID.findall(sentence.lower().replace("’", "'"))
        said += len(words)
        if words and _REFUSAL.accepts(words):
            declining += len(words)
    return declining > 0 and declining >= REFUSAL_SHARE * said


def _plain(text: str) -> str:
    return _CODE.sub(" ", text)


def defect(prompt: str | None, reply: str | None) -> str | None:
    """The defect of a pair, or None for a sound one."""
    if reply is None:
        return "empty"
    r = _Reply(reply)
    if r.empty:
        return "empty"
    said = _fold(_ASKED.sub("", r.prose if r.json and r.prose else r.text))
    if prompt and covered(said, _fold(prompt)) >= COPY_SHARE:
        return "copy"
    if refuses(r.prose) or isinstance(r.value, dict) and isinstance(r.value.get("reasoning"), str) and refuses(r.value["reasoning"]):
        return "refusal"
    if r.truncated:
        return "truncated"
    if prompt:
        asked, _ = language(_plain(prompt))
        answered, votes = language(_plain(_QUOTED.sub(" ", r.prose)))
        if asked and answered and asked != answered and votes[answered] >= 1.2 and votes.get(asked, 0) * 2.5 <= votes[answered]:
            return "language"
    return None


def pairs(responses: DataFrame, results: DataFrame) -> DataFrame:
    """pair_kind, pair_id, prompt, reply of all pairs; duplicates of a key may still be there."""
    calls = F.coalesce(F.size(F.filter("tool_calls", lambda c: c.isNotNull())), F.lit(0))
    one = spread(responses.where(calls <= 0)).select(F.lit("response").alias("pair_kind"), F.col("response_id").cast("bigint").alias("pair_id"), "prompt", F.col("content").alias("reply"))
    asked = responses.select("response_id", "prompt")
    told = results.select(F.col("result_id").cast("bigint").alias("pair_id"), "response_id", F.col("reasoning").alias("reply"))
    # Results without a response meet no prompt and take no part in the join, where they would all share one key.
    two = told.where("response_id IS NOT NULL").join(asked, "response_id", "left").unionByName(told.where("response_id IS NULL").withColumn("prompt", F.lit(None).cast("string")), allowMissingColumns=True)
    return one.unionByName(two.select(F.lit("result").alias("pair_kind"), "pair_id", "prompt", "reply"))


def defects(pair_rows: DataFrame) -> DataFrame:
    """pair_kind, pair_id, defect of the defective pairs, each once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind, ids, prompts, replies = (batch.column(i).to_pylist() for i in range(4))
            found = [(k, i, d) for k, i, p, r in zip(kind, ids, prompts, replies) if (d := defect(p, r))]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), (pa.string(), pa.int64(), pa.string()))], names=["pair_kind", "pair_id", "defect"])

    out = pair_rows.select("pair_kind", "pair_id", F.col("prompt").cast("string"), F.col("reply").cast("string"))
    return out.mapInArrow(run, "pair_kind string, pair_id bigint, defect string").dropDuplicates(["pair_kind", "pair_id"])
