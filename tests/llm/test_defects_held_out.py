"""Wordings written apart from the seeds. The models were changed where they failed at first, so this is a validation set rather than an untouched one."""

import random

import pytest

from lexforge.llm.answer_defects import DefectModel

RNG = random.Random(31)
NOUNS = "supplier carrier agent licensee invoice schedule pallet ledger notice term crate ticket".split()


def ask():
    return RNG.choice(["What does the agreement say about the {} and the {}?", "Which rules apply to the {} if the {} is late?", "Who pays for the {} when the {} ends?"]).format(RNG.choice(NOUNS), RNG.choice(NOUNS))


def say(n):
    forms = ["The {} shall keep the {} within {} days after notice.", "Each {} must return the {} no later than day {}.", "The {} may not sell the {} before {} weeks have passed."]
    return " ".join(RNG.choice(forms).format(RNG.choice(NOUNS), RNG.choice(NOUNS), RNG.randint(2, 90)) for _ in range(n))


GERMAN = ("Was regelt der Vertrag über die Lieferung und wer trägt die Kosten?", "Der Lieferant trägt die Kosten der Verpackung. Die Mieterin zahlt die Fracht bis zum {}. Tag des Monats.")

REFUSALS = [
    "I'm really sorry, but answering that isn't something I can do.", "I can't assist with that.", "Unfortunately I'm not able to give you a view on this contract.", "As an AI, I don't offer legal opinions.", "I must respectfully decline to comment on this.", "I am not permitted to interpret this document for you.",
    "My instructions don't allow me to discuss it.", "I won't be answering this one.", "That lies outside what I may talk about.", "Please ask a solicitor, since I cannot advise on it.", "It would not be right for me to speculate here.", "Sorry, I am unable to help you with this question.",
    "Leider kann ich Ihnen dazu keine Antwort geben.", "Ich darf diese Frage nicht beantworten.", "Désolé, je ne peux pas vous aider avec cette question.", "Je ne suis pas autorisé à donner un avis sur ce contrat.", "Lo siento, no puedo responder a eso.", "No estoy autorizado a interpretar este contrato.",
]
LANGUAGE = [
    "Leverandøren skal opbevare alle dokumenter for egen regning, indtil fristen er udløbet.", "Dodavatel musí uchovávat všechny doklady na vlastní náklady až do konce lhůty.", "Поставщик обязан хранить все документы за свой счёт до истечения срока.", "供应商应自费保存所有文件，直至期限届满。", "Tedarikçi tüm belgeleri süre sonuna kadar kendi hesabına saklamakla yükümlüdür.",
    "Toimittajan on säilytettävä kaikki asiakirjat omalla kustannuksellaan määräajan loppuun asti.", "供給者は期限まで自己の費用ですべての書類を保管しなければならない。", "Il fornitore conserva tutti i documenti a proprie spese fino alla scadenza del termine.", "O fornecedor deve guardar todos os documentos às suas custas até ao fim do prazo.",
    "De leverancier bewaart alle documenten op eigen kosten tot het einde van de termijn.", "Dostawca przechowuje wszystkie dokumenty na własny koszt do końca terminu.", "Leverantören ska förvara alla handlingar på egen bekostnad tills fristen har löpt ut.", "Ο προμηθευτής φυλάσσει όλα τα έγγραφα με δικά του έξοδα.", "A szállító saját költségén köteles minden iratot megőrizni a határidő végéig.",
    "Furnizorul păstrează toate documentele pe cheltuiala sa până la sfârșitul termenului.", "El proveedor conserva todos los documentos por su cuenta hasta que venza el plazo.", "Le fournisseur conserve tous les documents à ses frais jusqu'à la fin du délai.", "يحتفظ المورد بجميع المستندات على نفقته حتى نهاية المدة",
]
EMPTY = [None, "", "   ", "​​", "~~~", "- -", "(none)", "Reply:", "[no text]", "Antwort: -", "….", "<null/>", "NULL.", "N / A", "_____", "Result: n/a"]
SOUND = [
    "The tenant may refuse to sign if the roof leaks.", "Nothing in the contract deals with this.", "Forty days.", "Only the buyer.", "The insurer is not able to pay before the report is filed.", "Yes, within two weeks.", "See clause 14.", "By registered post.", "I refer to clause 3: the owner keeps the keys.",
    "The agent cannot be asked to comment on prices.", "There is none.", "From May to July.", "The text is silent on it.", "A fee of 300 dollars a month.", "Apologies must be made in writing, says section 8.", "Each party bears its own costs; the seller delivers the goods to the port.",
]


@pytest.fixture(scope="module")
def model():
    sample = [(ask(), say(RNG.randint(1, 5))) for _ in range(320)] + [(GERMAN[0], GERMAN[1].format(i % 28 + 1)) for i in range(60)]
    return DefectModel().fit(sample)


@pytest.mark.parametrize("answers,label,least", [(REFUSALS, "refusal", 0.8), (LANGUAGE, "language", 0.9), (EMPTY, "empty", 0.8)])
def test_recall_on_unseen_wordings(model, answers, label, least):
    found = model.predict([(ask(), a) for a in answers])
    missed = [a for a, d in zip(answers, found) if d != label]
    assert len(missed) <= (1 - least) * len(answers), missed


def test_sound_answers_are_left_alone(model):
    pairs = [(ask(), a) for a in SOUND] + [(ask(), say(n)) for n in (1, 2, 4, 6) for _ in range(46)] + [(GERMAN[0], GERMAN[1].format(i)) for i in range(1, 9)]
    assert len(pairs) > 200
    found = [(a, d) for (_, a), d in zip(pairs, model.predict(pairs)) if d]
    assert len(found) <= 0.02 * len(pairs), found


def test_cuts_copies_and_several_labels(model):
    cut = [(ask(), say(n)[: -k].rstrip(" .")) for n in (1, 2, 3) for k in (7, 12, 20)]
    assert model.predict(cut).count("truncated") >= 8
    q = ask()
    assert model.predict([(q, q), (q, q.upper()), (q, f'"{q}"')]) == ["copy"] * 3
    both = model.certainties([(q, "Dodavatel musí uchovávat všechny doklady na vlastní náklady až do")])[0]
    assert (both > 0).sum() >= 2
