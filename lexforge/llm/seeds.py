"""Wordings from which models of this subpackage are fitted (fixed values), all of them of a general kind.

A pattern stands for all the texts it can be read as: `(a|b)` is one of the
alternatives, `(|a)` leaves one out. None is taken from a table.
"""

from __future__ import annotations

import math
import random
import re
from collections.abc import Iterator
from http import HTTPStatus

_CHOICE = re.compile(r"\(([^()]*)\)")


def readings(pattern: str, most: int = 1000) -> Iterator[str]:
    """The texts that a pattern stands for; of more than `most`, as many, drawn evenly."""
    options = [[p] if i % 2 == 0 else p.split("|") for i, p in enumerate(_CHOICE.split(pattern))]
    total = math.prod(map(len, options))
    for i in range(total) if total <= most else random.Random(total).sample(range(total), most):
        text = ""
        for o in options:
            i, at = divmod(i, len(o))
            text += o[at]
        yield " ".join(text.split())


def lines(block: str) -> list[str]:
    return [t for line in block.strip().split("\n") for t in readings(line)]


# --- Messages in place of a text -------------------------------------------------------------------------------

ERROR = """
(the|this|that|sorry, this|unfortunately the) (page|document|file|resource|record|address|link|content|article|item|site|report) (|you are trying to reach|you asked for|you requested|you were looking for|requested) (cannot be found|could not be found|was not found|no longer exists|does not exist|is unavailable|is not available right now|is temporarily unavailable|has been moved|was deleted|has been removed|cannot be displayed|failed to load|could not be opened|could not be retrieved|is missing)
(oops|sorry|whoops|we are sorry|apologies|uh-oh)(!|,|:|.) (something|an error|a problem|an exception|a failure|an unexpected error) (went wrong|occurred|has occurred|happened|broke) (|while|when) (processing your request|loading this page|opening the file|retrieving the record|contacting the server|on our side)
(please|kindly|you may|you can) (try once more|retry|reload|refresh|come back|check the url|check the spelling|contact the administrator|contact support|go back|return to the home page|sign in again|log in again) (|later|in a moment|in a few minutes|in some time|and try once more|shortly)
(access|permission|authorization|authentication|login|request) (denied|refused|rejected|failed|required|forbidden|is required|to this resource is denied|to this page is restricted)
(you|this account|the current user) (do not have|does not have|lack|are missing) (permission|access|the rights|authorization|the privileges) to (view|open|access|read|see) (this|the requested) (page|document|file|resource)
(your|the|this) (session|login|token|link|ticket) (has expired|expired|timed out|is no longer valid|is invalid|has ended)(|. please log in again|. sign in to go on)
(the|our|this) (server|service|site|system|database|application|host|backend) (is|is currently|is temporarily) (down|unavailable|overloaded|offline|under maintenance|not responding|busy|unreachable)
(the|our) (server|site|backend|proxy) (encountered|reported|returned|sent|met with) (an|an internal|an unexpected) (error|failure|problem|response)(| and could not complete your request| and was unable to answer)
(connection|request|gateway|operation|query|upstream|socket|download|conversion|transfer) (timed out|timeout|refused|reset by peer|failed|was aborted|closed unexpectedly|lost|interrupted)
(fatal|unhandled|uncaught|internal|runtime|syntax|parse|database|application|server|unknown) (error|exception|failure)(|:) (|null pointer|null reference|out of memory|index out of range|undefined variable|division by zero|stack overflow|undefined function) (|in module|in file|in template|on) (|line 12|line 7)
(could not|cannot|unable to|failed to|error: could not) (connect to|load|open|read|convert|render|parse|fetch|retrieve|display|process|reach|establish a connection to) the (database|file|document|server|page|template|record|resource|content|host)
(error|request|reference|incident|trace|ticket|support|correlation) (id|number|code|reference): (a1b2c3d4|7f3e0912|00000)
(unsupported|invalid|unknown|corrupt|damaged|unrecognised) (file type|file format|request|document|parameter|encoding|media type|input)
(rate limit|quota|bandwidth limit|download limit) exceeded. (too many|you have sent too many) (requests|attempts|connections). (slow down|wait a while|wait 60 seconds) and (retry|try again)
(this|the) (site|domain|account|website|page) (has been|is|was) (suspended|closed|disabled|blocked|parked|taken offline)
(sorry,|unfortunately,|apologies,|) (that|this|the) (page|document|file|contract|entry|attachment|agreement|form|listing|message|image|profile) (does not exist|is not available|is not here|cannot be reached|has gone|is no longer here|was withdrawn) (|anymore|any longer|at the moment|at present|on this server|at this address)
(we|the server|the service|the system|the viewer|this site) (could not|cannot|was unable to|failed to|did not manage to) (load|deliver|provide|send|find|show|open|supply|produce|return) (this|the|that|your) (page|document|file|contract|entry|attachment|agreement|form|listing|message|image|filing|record)
(please|kindly|you may) (check|verify|correct) (the|your) (address|url|link|spelling|entry) (|of the page|of the site|of the file|you entered|and try again|or try later|or come back later)
the (link|address|url|bookmark) (you followed|you clicked|you entered|) (may be|is|might be|seems to be) (broken|dead|wrong|outdated|mistyped|incorrect), or the (page|document|file) (may have been|was|has been) (moved|removed|taken down|renamed)
(our|the) (engineers|team|administrators|technicians|staff) (have|has) been (notified|informed|alerted). (we are looking into it|we are working on it|come back soon|thank you for your patience)
no (results|content|page|such file|such page|such record|matching page) (found|available|to display|at this address|here)
bad (request|gateway|link|url). the (request|url|address) (was malformed|is not valid|could not be understood)
(dns|ssl|proxy|certificate|network|socket) (error|failure|lookup failed|handshake failed). (check your connection|no internet connection|the host name could not be resolved)
(die|diese|die gesuchte|die angeforderte|die aufgerufene) (seite|datei|adresse|ressource|unterlage) (wurde nicht gefunden|konnte nicht gefunden werden|existiert nicht|ist nicht verfügbar|ist derzeit nicht erreichbar|konnte nicht geladen werden|wurde gelöscht|wurde verschoben)
(das|dieses|das angeforderte|das gesuchte) (dokument|verzeichnis|objekt) (wurde nicht gefunden|konnte nicht geöffnet werden|existiert nicht|ist nicht vorhanden|ist vorübergehend nicht verfügbar|ist nicht mehr verfügbar)
(zugriff|anmeldung|zugang) (verweigert|fehlgeschlagen|gesperrt|nicht erlaubt). sie haben keine (berechtigung|zugriffsrechte) für diese (seite|datei)
(es ist|leider ist) ein (fehler|interner fehler|unerwarteter fehler|problem) aufgetreten. bitte (versuchen sie es später erneut|laden sie die seite neu|wenden sie sich an den administrator)
(interner serverfehler|der server ist überlastet|der dienst ist nicht erreichbar|zeitüberschreitung der anfrage|ihre sitzung ist abgelaufen|verbindung zur datenbank fehlgeschlagen|der server antwortet nicht)
(la|cette) (page|ressource|adresse) (demandée|recherchée|que vous cherchez|) (n'existe pas|n'existe plus|est introuvable|n'a pas été trouvée|n'est pas disponible|a été déplacée|a été supprimée|ne peut pas être affichée)
(le|ce) (document|fichier|site|service|serveur) (demandé|) (n'existe plus|est introuvable|est indisponible|est temporairement indisponible|n'est pas accessible|ne répond pas|n'a pas pu être chargé)
(accès|connexion) (refusé|interdit|impossible|expirée|refusée). vous n'avez pas (la permission|l'autorisation|le droit) d'accéder à cette page
(une erreur|une erreur interne|un problème|une erreur inattendue) (est survenue|s'est produite|s'est produit). veuillez (réessayer plus tard|recharger la page|contacter l'administrateur)
(erreur interne du serveur|délai d'attente dépassé|votre session a expiré|échec de la connexion à la base de données|trop de requêtes|requête incorrecte)
(la|esta) (página|dirección|sección) (solicitada|que busca|) (no existe|no se encuentra|no se ha encontrado|no está disponible|ha sido eliminada|fue movida|no se puede mostrar)
(el|este) (documento|archivo|recurso|servidor|servicio|sitio) (solicitado|) (no existe|no se encuentra|no está disponible|no está disponible en este momento|no responde|no pudo cargarse|no se puede abrir)
(acceso|permiso) (denegado|prohibido|restringido). no tiene (permiso|autorización) para (ver|abrir) esta página
(se produjo|ha ocurrido|ocurrió) un (error|error interno|error inesperado|problema). (inténtelo de nuevo más tarde|vuelva a cargar la página|póngase en contacto con el administrador)
(error interno del servidor|tiempo de espera agotado|su sesión ha caducado|error de conexión con la base de datos|demasiadas solicitudes)
(la|questa) pagina (richiesta|cercata|) (non esiste|non è stata trovata|non è disponibile|è stata rimossa|non può essere visualizzata)
(il|questo) (documento|file|server|servizio|sito) (richiesto|) (non esiste|non è stato trovato|non è disponibile|non risponde|non può essere aperto). (accesso negato|si è verificato un errore|errore interno del server|riprova più tardi|sessione scaduta)
(a|esta) página (solicitada|) (não existe|não foi encontrada|não está disponível|foi removida|não pode ser exibida). (acesso negado|ocorreu um erro|erro interno do servidor|tente novamente mais tarde|sua sessão expirou|o documento não foi encontrado|o arquivo não existe)
de (pagina|gevraagde pagina) (is niet gevonden|kon niet worden gevonden|bestaat niet meer|is niet beschikbaar). (toegang geweigerd|er is een fout opgetreden|interne serverfout|probeer het later opnieuw|uw sessie is verlopen|het document is niet gevonden|het bestand bestaat niet)
(strona|podana strona|strona, której szukasz,) (nie została znaleziona|nie istnieje|jest niedostępna). (dostęp zabroniony|odmowa dostępu|wystąpił błąd|wewnętrzny błąd serwera|spróbuj ponownie później|sesja wygasła|nie znaleziono dokumentu|plik nie istnieje|nie znaleziono strony)
(sidan|den sökta sidan) (hittades inte|kunde inte hittas|finns inte|är inte tillgänglig). (åtkomst nekad|ett fel har uppstått|internt serverfel|försök igen senare|sessionen har gått ut|dokumentet hittades inte)
(siden|den ønskede side) (blev ikke fundet|ble ikke funnet|findes ikke|finnes ikke|er ikke tilgængelig|er ikke tilgjengelig). (adgang nægtet|ingen tilgang|der opstod en fejl|det oppstod en feil|intern serverfejl|prøv igen senere|prøv igjen senere)
(sivua|etsimääsi sivua|asiakirjaa|tiedostoa) (ei löydy|ei löytynyt|ei ole olemassa). (pääsy evätty|tapahtui virhe|palvelinvirhe|yritä myöhemmin uudelleen|istunto on vanhentunut|palvelu ei ole käytettävissä)
(stránka|požadovaná stránka|stránka, kterou hledáte,) (nebyla nalezena|neexistuje|není dostupná). (přístup odepřen|došlo k chybě|vnitřní chyba serveru|zkuste to později|platnost relace vypršela|dokument nebyl nalezen|soubor neexistuje)
(sayfa|aradığınız sayfa|istenen belge|dosya) (bulunamadı|mevcut değil|artık yok|kullanılamıyor). (erişim reddedildi|bir hata oluştu|sunucu hatası|lütfen daha sonra tekrar deneyin|oturumunuzun süresi doldu)
(az oldal|a keresett oldal|a kért dokumentum) (nem található|nem létezik|nem elérhető). (hozzáférés megtagadva|hiba történt|belső szerverhiba|próbálja meg később)
(pagina|pagina căutată|documentul solicitat) (nu a fost găsită|nu există|nu este disponibilă|nu a fost găsit). (acces interzis|a apărut o eroare|eroare internă de server|încercați din nou mai târziu)
(страница|запрашиваемая страница|эта страница) (не найдена|не существует|удалена|недоступна|была перемещена). (документ не найден|файл не найден|доступ запрещён|произошла ошибка|внутренняя ошибка сервера|попробуйте позже|повторите попытку позже|сервер не отвечает|сервис временно недоступен|срок действия сеанса истёк)
(сторінку|сторінка) (не знайдено|не існує|недоступна). (доступ заборонено|сталася помилка|спробуйте пізніше|внутрішня помилка сервера)
(η σελίδα|το έγγραφο) (δεν βρέθηκε|δεν υπάρχει|δεν είναι διαθέσιμη). (παρουσιάστηκε σφάλμα|απαγορεύεται η πρόσβαση|εσωτερικό σφάλμα διακομιστή|δοκιμάστε ξανά αργότερα)
(页面|网页|您访问的页面|您要查找的页面|请求的文件|该文档|文档) (不存在|未找到|找不到|无法找到|已被删除|无法显示|无法打开|暂时无法访问)。(访问被拒绝|没有权限访问|服务器内部错误|发生错误|服务不可用|请稍后再试|请稍后重试|会话已过期|连接超时|请求超时)
(頁面|您要求的頁面|文件) (不存在|找不到|無法顯示|無法開啟)。(拒絕存取|伺服器錯誤|發生錯誤|請稍後再試)
(ページ|お探しのページ|指定されたページ|要求されたファイル|この文書) (が見つかりません|は見つかりませんでした|は存在しません|は削除されました|を表示できません|は現在利用できません)。(アクセスが拒否されました|サーバー内部エラー|エラーが発生しました|しばらくしてからもう一度お試しください|セッションの有効期限が切れました|接続がタイムアウトしました)
(페이지|요청하신 페이지|찾으시는 페이지|문서)(를 찾을 수 없습니다|가 존재하지 않습니다|가 삭제되었습니다). (접근이 거부되었습니다|오류가 발생했습니다|서버 내부 오류|잠시 후 다시 시도해 주세요)
(الصفحة|الصفحة المطلوبة|المستند|الملف) (غير موجودة|غير موجود|غير متاحة|لم يتم العثور عليها). (تم رفض الوصول|حدث خطأ|خطأ داخلي في الخادم|يرجى المحاولة لاحقا)
(הדף|הדף המבוקש|המסמך) (לא נמצא|אינו קיים|אינו זמין). (הגישה נדחתה|אירעה שגיאה|שגיאת שרת פנימית|נסה שוב מאוחר יותר)
(पृष्ठ|अनुरोधित पृष्ठ|दस्तावेज़) (नहीं मिला|उपलब्ध नहीं है|मौजूद नहीं है). (पहुँच अस्वीकृत|एक त्रुटि हुई|सर्वर त्रुटि|कृपया बाद में पुनः प्रयास करें)
(такой страницы|запрошенного файла|этого документа) (нет|больше нет|не существует). (документ|файл|адрес) (удалён|перемещён|устарел|не удалось открыть|не удалось загрузить). (проверьте адрес|обновите страницу|обратитесь к администратору|у вас нет прав доступа|соединение прервано|истекло время ожидания)
(bu|aradığınız|istediğiniz) (sayfaya|belgeye|dosyaya) (şu anda|) (ulaşılamıyor|erişilemiyor). (sayfa yüklenemedi|bağlantı zaman aşımına uğradı|adresi kontrol edin|sunucu yanıt vermiyor|yetkiniz yok)
服务器(繁忙|异常|出错|无响应|暂时不可用|开小差了)。请(刷新页面|检查网址|联系管理员|返回首页|重新登录|稍候片刻)。(页面|文件|内容)(加载失败|已失效|已过期|出错了|打不开)
(ページ|ファイル|文書|コンテンツ)(が表示できません|を読み込めません|にアクセスできません|を開けません)。(再度お試しください|管理者にお問い合わせください|アドレスをご確認ください|サーバーが応答していません|権限がありません)
(페이지|파일|문서)(를 표시할 수 없습니다|를 열 수 없습니다|에 접근할 수 없습니다). (주소를 확인해 주세요|관리자에게 문의하세요|서버가 응답하지 않습니다|권한이 없습니다|세션이 만료되었습니다)
(تعذر|لا يمكن) (فتح|عرض|تحميل|الوصول إلى) (الصفحة|الملف|المستند). (تحقق من العنوان|انتهت مهلة الاتصال|ليس لديك إذن|الخادم لا يستجيب|انتهت صلاحية الجلسة)
(não foi possível|nao foi possivel|non è stato possibile|no fue posible|impossible de|impossibile) (abrir|carregar|aprire|caricare|cargar|charger|afficher|mostrar|visualizzare) (a página|o documento|la pagina|il documento|la página|el documento|la page|le document)
(sidan|siden|dokumentet|filen) (kunde inte laddas|kunne ikke indlæses|kunne ikke lastes|er flyttet|har flyttats|är borttagen). (kontrollera adressen|kontroller adressen|servern svarar inte|serveren svarer ikke|du saknar behörighet|du har ikke adgang)
(sivun|tiedoston|asiakirjan) (lataaminen|avaaminen) epäonnistui. (tarkista osoite|palvelin ei vastaa|sinulla ei ole oikeuksia|sivu on poistettu|sivu on siirretty)
(nie można|nie udało się) (otworzyć|wczytać|wyświetlić) (strony|pliku|dokumentu). (sprawdź adres|serwer nie odpowiada|brak uprawnień|przekroczono czas oczekiwania). (stránku|soubor|dokument) (nelze|se nepodařilo) (otevřít|načíst|zobrazit). (zkontrolujte adresu|server neodpovídá|nemáte oprávnění)
"""


def http_messages() -> list[str]:
    """The standard's own names of states in the forms in which servers print them."""
    out = []
    for s in HTTPStatus:
        if s >= 400:
            out += [f"{s.value} {s.phrase}", f"error {s.value}", f"error {s.value}: {s.phrase}", f"http {s.value} {s.phrase}", f"http error {s.value} - {s.phrase}", f"status {s.value} ({s.phrase})", f"{s.phrase}. {s.description}", f"fehler {s.value}", f"erreur {s.value}", f"ошибка {s.value}", f"错误 {s.value}"]
    return out


SCRIPT = """
(please|you must|you need to|you have to|kindly|to continue,|to go on,|in order to read this,) (enable|activate|turn on|switch on|allow|permit) (javascript|js|scripts|scripting|client-side scripts|javascript and cookies|scripts and cookies) (|in your browser|in the browser settings|for this site|for this page|to continue|to view this page|to use this app|to see the content|to run this application|before you go on) (|and reload|and try again|and refresh the page|and come back)
(javascript|js|scripting|client-side scripting|script execution) (is|seems to be|appears to be|has been|is currently) (disabled|turned off|switched off|blocked|not enabled|unavailable|deactivated|inactive) (|in your browser|by your settings|by an extension|on this device)
(this|our|the) (page|site|website|application|app|document|viewer|portal) (requires|needs|relies on|depends on|works only with|does not work without|will not work properly without|cannot be shown without|must be viewed with) (javascript|scripts|scripting|js|javascript enabled|client-side scripts)
your (browser|device|client) (does not support|has disabled|blocks|is blocking|is not running|does not run) (javascript|scripts|scripting|js)
(for|to get) (the full|full|all|complete) (functionality|use|features|experience) (|of this site|of this page|of the application), (it is necessary|you need|it is required|you have) to (allow|enable|activate) (javascript|scripts|scripts and cookies)
(this|our) (site|page|reader|viewer) (uses|runs on|is built with) (javascript|scripts) to (show|display|load|render) (the text|its content|documents|pages). (turn them on|enable them|activate them|allow them) in your (settings|browser|preferences)
(enable|activate|allow|turn on|switch on) (js|javascript|scripts|scripting) (and disable|and turn off|and pause) (your|all) (ad blockers|blockers|extensions)
to (read|view|open|see|use) this (page|document|text|file|site), (allow|enable|activate|turn on|switch on) (js|javascript|scripts|scripting)
if you (use|have|run) (an ad blocker|a script blocker|a content blocker|noscript), (disable|turn off|pause|deactivate) it (|for this site|and reload)
(without|with no) (javascript|scripts|scripting) (nothing|no content|only part of this page) can be (shown|displayed|loaded)
bitte (aktivieren|erlauben|schalten) sie (javascript|skripte|scripting) (|in ihrem browser|in den einstellungen ihres browsers) (|ein|, um fortzufahren|, um die seite zu sehen|, um den inhalt anzuzeigen)
(javascript|scripting) ist (|in ihrem browser) (deaktiviert|ausgeschaltet|nicht aktiviert|blockiert). (diese seite|diese anwendung|dieser inhalt) (benötigt|erfordert|funktioniert nur mit|funktioniert nicht ohne) javascript
(veuillez|merci de|vous devez) (activer|autoriser) (javascript|les scripts) (|dans votre navigateur) (pour continuer|pour voir cette page|pour utiliser ce site)
javascript (est désactivé|n'est pas activé|est bloqué) (|dans votre navigateur). (ce site|cette page|cette application) (nécessite|requiert|a besoin de|ne fonctionne pas sans) javascript
(por favor,|debe|necesita) (active|activar|habilite|habilitar|permita) javascript (|en su navegador) (para continuar|para ver esta página|para usar este sitio)
javascript (está desactivado|está deshabilitado|no está habilitado|está bloqueado) (|en su navegador). (este sitio|esta página|esta aplicación) (requiere|necesita|no funciona sin) javascript
(attiva|abilita|per continuare attiva|si prega di abilitare) javascript (|nel browser|nel tuo browser). javascript (è disattivato|è disabilitato|non è attivo). (questa pagina|questo sito) (richiede|ha bisogno di|non funziona senza) javascript
(ative|habilite|por favor, ative) o javascript (|no seu navegador) (para continuar|para ver esta página). (este site|esta página) (requer|precisa de) javascript. o javascript está (desativado|desabilitado)
(schakel|zet) javascript (in|aan) (|in uw browser) (om door te gaan|om deze pagina te bekijken). (deze pagina|deze site) (vereist|heeft) javascript (|nodig). javascript is uitgeschakeld
(włącz|proszę włączyć) (javascript|obsługę javascript) (|w przeglądarce)(|, aby kontynuować). (ta strona|ta witryna) (wymaga|nie działa bez) javascript. javascript jest wyłączony
(aktivera|slå på|slå til|aktiver) javascript (|i din webbläsare|i din browser|i nettleseren). (den här sidan|denne side|denne siden) kräver javascript. javascript er (slået fra|deaktivert)
(ota javascript käyttöön|salli javascript) selaimessasi. tämä sivu vaatii javascriptin. javascript on pois käytöstä
(zapněte|povolte) (javascript|skripty) (|v prohlížeči). (tato stránka|tento web) vyžaduje javascript. javascript je (vypnutý|zakázán)
(lütfen|devam etmek için) (javascript'i|javascript) (etkinleştirin|açın). bu (sayfa|site) javascript gerektirir. javascript devre dışı
kérjük, engedélyezze a javascriptet a böngészőben. az oldal javascriptet igényel. vă rugăm să activați javascript în browser. această pagină necesită javascript
(пожалуйста,|) (включите|разрешите) (javascript|скрипты|выполнение сценариев) (|в браузере|в настройках браузера) (|для продолжения|, чтобы увидеть страницу). (для работы сайта|для просмотра страницы) (нужен|требуется|необходим) javascript. javascript отключён
(увімкніть|дозвольте) javascript у браузері. для цієї сторінки потрібен javascript. ενεργοποιήστε τη javascript στον περιηγητή. η σελίδα απαιτεί javascript
(请|请先|您需要)(启用|开启|打开)(浏览器的|) javascript (|以继续|后再访问|后刷新页面)。(本页面|此网站|该应用)(需要|依赖) javascript。(您的浏览器|浏览器)(禁用了|不支持|未启用) javascript
(請)(啟用|開啟) javascript。本頁需要 javascript。javascript 已停用
javascript (を有効にしてください|を有効にして再読み込みしてください|が無効になっています|が必要です)。(このページ|このサイト|本アプリ)(を表示するには|の利用には) javascript が必要です。(ブラウザの設定で) javascript を有効にしてください
(브라우저에서|) 자바스크립트를 (활성화해|사용하도록 설정해|켜) 주세요. 이 페이지는 자바스크립트가 필요합니다. javascript를 활성화해 주십시오
(يرجى|الرجاء) (تفعيل|تمكين) جافا سكريبت (|في المتصفح|للمتابعة). هذه الصفحة تتطلب javascript. (אנא|) הפעל javascript בדפדפן. דף זה דורש javascript. कृपया अपने ब्राउज़र में javascript सक्षम करें
(ohne|sans|sin|senza|sem|zonder|bez|utan|uden|uten|без) javascript (funktioniert diese seite nicht|cette page ne fonctionne pas|esta página no funciona|questa pagina non funziona|esta página não funciona|werkt deze pagina niet|ta strona nie działa|fungerar inte sidan|fungerer siden ikke|страница не работает)
(для|чтобы) (отображения|просмотра|работы|увидеть|открыть) (страницы|документа|содержимого|сайта|страницу|документ) (включите|нужно включить|необходимо включить|требуется) (javascript|поддержку javascript|скрипты)
(aktivoi|salli|ota käyttöön) (javascript|skriptit) (jatkaaksesi|nähdäksesi sisällön|selaimen asetuksista). (per visualizzare|per vedere|para ver|para ler|pour lire|om te lezen|för att läsa|for at se) (il contenuto|o conteúdo|el contenido|le contenu|de inhoud|innehållet|indholdet) (occorre|è necessario|é preciso|es necesario|il faut|moet u|måste du|skal du) (abilitare|attivare|ativar|activar|activer|inschakelen|aktivera|aktivere) javascript
"""

FILLER = """
lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor incididunt ut labore et dolore magna aliqua
ut enim ad minim veniam, quis nostrud exercitation ullamco laboris nisi ut aliquip ex ea commodo consequat
duis aute irure dolor in reprehenderit in voluptate velit esse cillum dolore eu fugiat nulla pariatur
excepteur sint occaecat cupidatat non proident, sunt in culpa qui officia deserunt mollit anim id est laborum
sed ut perspiciatis unde omnis iste natus error sit voluptatem accusantium doloremque laudantium, totam rem aperiam, eaque ipsa quae ab illo inventore veritatis
nemo enim ipsam voluptatem quia voluptas sit aspernatur aut odit aut fugit, sed quia consequuntur magni dolores eos qui ratione sequi nesciunt
at vero eos et accusamus et iusto odio dignissimos ducimus qui blanditiis praesentium voluptatum deleniti atque corrupti quos dolores et quas molestias
vestibulum ante ipsum primis in faucibus orci luctus et ultrices posuere cubilia curae; pellentesque habitant morbi tristique senectus et netus et malesuada fames ac turpis egestas
praesent dapibus, neque id cursus faucibus, tortor neque egestas augue, eu vulputate magna eros eu erat. aliquam erat volutpat. nam dui mi, tincidunt quis, accumsan porttitor
maecenas sed diam eget risus varius blandit sit amet non magna. cras mattis consectetur purus sit amet fermentum. vivamus sagittis lacus vel augue laoreet rutrum
(this|the|all) (text|paragraph|copy|wording|content|section) (here|below|above|) (is|serves as|stands in as|is only|is just) (filler|dummy|sample|placeholder|temporary|nonsense|blind) (text|copy|content|wording) (|and will be replaced|and has no meaning|until the real text arrives|to show the layout|for the layout|that fills the page|for testing)
(your|the real|the final|actual|more) (text|content|copy|words|wording|description) (goes|comes|belongs|will be placed|will appear|will stand) (here|in this place|at this spot|soon|later)
(replace|overwrite|exchange|change) (this|the) (text|paragraph|sample|content|block) (with|by) (your|the real|the final|actual) (own text|content|wording|copy|words)
(type|write|put|enter|add|paste) (some|your|the) (text|words|content|copy) (here|in here|in this field). (text|content|copy) (to come|to follow|coming soon|pending)
(sample|dummy|filler|test|example|blind) (text|clause|paragraph|sentence|content|section) (1|one|number one|a). (sample|dummy|filler|test|example|blind) (text|clause|paragraph|sentence|content|section) (2|two|number two|b). (sample|dummy|filler|test|example|blind) (text|clause|paragraph|sentence|content|section) (3|three|number three|c)
(hier steht|dies ist) (nur|ein) (blindtext|platzhaltertext|beispieltext|fülltext). (der text wird noch ersetzt|bitte ersetzen sie diesen text|dieser absatz dient nur als platzhalter)
(ceci est un|voici un) (faux texte|texte de remplissage|texte factice|texte provisoire). (remplacez ce texte par le vôtre|ce paragraphe sera remplacé)
(esto es un|este es un) (texto de relleno|texto de prueba|texto ficticio|texto de ejemplo). (reemplace este texto|este párrafo será sustituido)
(questo è un testo|este é um texto|dit is een tekst|to jest tekst) (segnaposto|di riempimento|de preenchimento|provisório|als opvulling|zastępczy). это текст-заполнитель. (это пример текста|здесь будет ваш текст). (这里是占位文本|这是示例文本|此处为测试文字)。(これはダミーテキストです|ここに文章が入ります|サンプルテキスト)
"""


def mash() -> list[str]:
    """What hands on a keyboard or a repeated word give: runs of neighbouring keys, and single words again and again."""
    rows = ("qwertyuiop", "asdfghjkl", "zxcvbnm", "qwertzuiop", "yxcvbnm", "azertyuiop", "qsdfghjklm", "wxcvbn", "1234567890", "йцукенгшщзх", "фывапролдж", "ячсмитьбю")
    keys = [row[i : i + n] for row in rows for n in (3, 4, 5, 6) for i in range(0, len(row) - n + 1)]
    out = []
    for i, k in enumerate(keys):  # every run beside others, as in typing without sense
        out.append(" ".join(keys[(i * j + j) % len(keys)] if j else k for j in range(6)) + f" {k} {k} test {k}")
    starts = ("asdf", "qwer", "zxcv", "jkl", "asdfgh", "qwerty", "hjkl", "uiop", "test", "fghj", "dfgh", "yxcv")
    out += [f"{a} {b} {a} {c}" for a in starts for b in starts for c in starts[:6]]
    for w in ("blah", "bla", "foo", "bar", "baz", "text", "test", "word", "words", "dummy", "sample", "abc", "xyz", "aaa", "xxx", "xxxx", "xx", "xxxxxx", "x", "lorem", "ipsum", "etc", "tbd", "todo", "yada", "la", "na", "ha", "hello", "some text", "more text", "foo bar", "...", "一二三", "测试", "тест", "текст"):
        out += [f"{w} " * 6, f"{w}, " * 4, f"{w}. " * 4]
    out += [f"{a} {b} {c} {a}" for a in ("xx", "xxx", "xxxx", "xxxxx", "xxxxxx") for b in ("xx", "xxxx", "xxxxxx") for c in ("xxx", "xx", "xxxxx")]
    return out


FURNITURE = """
(home|start|news|about us|products|services|contact|search|help|blog|sitemap|login|archive|downloads|careers) (-|·|/|>|∙) (home|news|about us|products|services|contact|search|help|faq|sitemap|login|archive|imprint) (-|·|/|>|∙) (contact|search|help|login|cookies|legal notice|imprint|accessibility)
(skip to|jump to|back to|go to|return to) (main content|the content|navigation|the top|top of page|start|the home page|the overview|the main page|search)
(powered|hosted|provided|built|served) by (our own system|a content system|the web team|the archive|the portal)
(terms of service|terms and conditions|privacy policy|privacy notice|cookie settings|legal notice|help centre|imprint|accessibility) (-|·|/) (privacy|help|terms|cookies|contact|support) (|- help|- contact)
(© 2019|copyright 2021|(c) 2020). all rights (are|) reserved. loading (|content|page|please wait)...
(need help|questions|any trouble|lost)? (contact|write to|call|ask|mail) (us|the help desk|support|our team|the service team|the webmaster)
<html> <head> <title> </title> </head> <body> <h1> </h1> <p> </p> <br> <div> </div> </body> </html> <!doctype html> <meta charset> &nbsp; &amp; noscript <noscript> </noscript>
(menu|log in|sign up|register|share|print|next|previous|close|accept all|decline|subscribe|read more|show more|download|language)
"""

#: Ordinary prose about many things, some of it about the very things that messages are about.
GENERAL = """
The river rises in the hills above the town and reaches the sea after some sixty miles. In spring the snow melts and the water floods the lower meadows, where cattle graze until late autumn.
She put the letter back in the drawer, locked it and went out into the garden, where her brother was still reading under the apple tree.
A web server waits for requests and sends the page that belongs to each address. If no page has that address, it answers with a code that tells the browser so, and most sites then show a short message of their own.
JavaScript is a programming language that browsers have been able to run since the nineties. Scripts change what a page shows after it was loaded, send data to a server or check what was typed into a form.
To open a file, the program asks the operating system for a handle; if the file doesn't exist or the user has no permission to read it, an exception is raised, which the calling function may handle.
The function returns the number of items that were found, or zero if the list is empty. Its second argument gives the place at which the search begins; negative values count from the end.
Typesetters have long used passages of scrambled Latin to judge a layout before the words were written. A template has fields that are filled when a letter is printed.
The committee met on Tuesday to discuss the budget for the coming year. Members asked why spending on roads had fallen while the cost of new schools had risen by a tenth.
Add the onions and cook them slowly until they are soft, then stir in the flour, the stock and a little salt. Bake for forty minutes and serve with bread.
Doctors found that patients who walked for half an hour each day slept better and needed less medicine than those who did not. The study followed four hundred people over six years.
You may copy and distribute this work in any medium, provided that you give each recipient a copy of this licence and keep all notices intact. The software is provided as is, without warranty of any kind.
The team won its third match in a row, although two players were sent off before the break. The coach said afterwards that the defence had never been so strong.
Shares fell on Friday after the bank reported lower profits. Analysts expect interest rates to stay where they are until the end of the summer.
In the seventeenth century the harbour was one of the busiest on the coast, and ships from many countries unloaded timber, wine and cloth at its quays.
The parser reads a line, splits it into tokens and builds a tree. Each node of the tree has a type and a list of children, and the compiler turns it into instructions for the machine.
An exception stops the normal flow of a program, and the nearest handler that fits decides what happens next. If there is none, the program ends and prints where the error occurred. Handlers may name several kinds of error, clean up and raise the exception again.
A type tells which operations an object supports. Objects that cannot change after they were created can be shared without copying; if an implementation checks types while it runs, an operation on the wrong type raises an error.
The current module is executed from top to bottom; names in its code refer to objects, and a name that has not been bound yet may not be used. The debugger shows the frame in which execution stopped and lets the user continue from there.
Our maintenance team replaced the pump, and the service was available again by noon. Customers who could not log in during the night received an apology and a refund.
Der Zug hielt eine Stunde lang auf freier Strecke, weil ein Baum auf die Gleise gestürzt war. Die Reisenden warteten geduldig und erzählten einander, wohin sie wollten. Ein Server liefert Seiten aus, und wenn eine Seite fehlt, meldet er das dem Browser.
Le village se trouve au bord d'un lac entouré de forêts. En été, les enfants y apprennent à nager et les pêcheurs rentrent avant la nuit. Un serveur envoie les pages que le navigateur demande et signale celles qui manquent.
El mercado abre a las siete y cierra a mediodía. Las mujeres venden fruta, queso y flores, y los hombres juegan a las cartas bajo los árboles. Un servidor envía las páginas que pide el navegador y avisa cuando falta alguna.
Il treno parte ogni mattina dalla stazione vecchia e attraversa la valle fino al mare. O mercado abre cedo e fecha ao meio-dia. De trein vertrekt elke ochtend van het oude station. Pociąg odjeżdża codziennie rano ze starego dworca.
Поезд отправляется каждое утро со старого вокзала и идёт через долину к морю. Сервер отправляет страницы, которые запрашивает браузер. 火车每天早上从旧车站出发，穿过山谷驶向大海。服务器把浏览器请求的页面发送给用户。電車は毎朝古い駅を出て谷を通り海へ向かう。サーバーはページを送る。
"""

# --- Answers ---------------------------------------------------------------------------------------------------

REFUSAL = """
(i'm sorry, but|i am sorry,|unfortunately,|i apologise, but|regrettably,|i regret that|i'm afraid|sorry, but|thank you, but|) i (can't|cannot|am unable to|am not able to|won't|will not|must decline to|have to decline to|am not allowed to|am not permitted to|would rather not|prefer not to|am not in a position to|decline to|refuse to) (answer|help with|assist with|comment on|discuss|respond to|advise on|interpret|analyse|speak about|give an opinion on|provide information on|assist you with) (this|that|this question|that question|your request|your question|this matter|legal matters|such documents|this topic|it|legal questions|that kind of question)
as (an ai|an ai model|a language model|an assistant|an automated system|a chatbot|a virtual assistant), i (can't|cannot|am unable to|am not able to|do not|am not allowed to|should not|may not) (answer|give legal advice|provide legal advice|interpret contracts|review documents|have opinions|comment on contracts|offer legal opinions)
(that|this|your question|this request) (is|falls|lies|goes) (outside|beyond) (what i can|what i may|the scope of what i may|the limits of what i can|my remit to) (answer|discuss|do|talk about|comment on|help with)
it (would be improper|would be wrong|would be irresponsible|would not be right|is not possible|isn't possible) for me to (answer|comment|respond|give advice|judge this|share an opinion|speculate)
(my|the) (guidelines|rules|policies|instructions|usage policy|safety rules|terms) (do not allow|do not permit|prevent|forbid|keep|don't let|prohibit) me (to answer|from answering|to discuss this|from commenting on this|to help|from giving advice|to give advice) (|on legal matters|here|on this)
(please|you should|i suggest that you|it is best to) (consult|ask|contact|see|speak to|turn to) (a lawyer|an expert|a solicitor|a professional|a specialist|an attorney) (instead|about this|for that|as i cannot answer|since i can't advise you|because i may not interpret this)
(no comment|i have no comment on this|i have nothing to say about that|i'd rather stay silent on this|i must refrain from commenting|i must pass on this question|i will have to pass on this one)
i (do not|don't) (feel comfortable|feel able|think i should|think it right|have the ability|have permission|have the authority|wish) to (answer|answering|respond|comment|share a view|review this|analyse this clause|give an answer) (|this|here|on that)
(answering|responding to|commenting on) (this|that|your question) (would violate|would breach|would go against|is against|conflicts with) (my rules|my guidelines|my policy|the usage policy|my instructions)
(es tut mir leid,|leider|bedauerlicherweise|entschuldigung,|) (ich kann|kann ich|darf ich|ich darf) (|ihnen) (|hierzu|dazu|dabei|diese frage|das|diese anfrage) (nicht helfen|nicht beantworten|keine auskunft geben|keine rechtsberatung geben|nicht kommentieren|nichts sagen|keine antwort geben|nicht auslegen)
als (ki|sprachmodell|assistent|automatisches system) (kann|darf) ich (keine rechtsberatung geben|diese frage nicht beantworten|verträge nicht auslegen|dazu nichts sagen). (ich muss|ich möchte) (die antwort|die beantwortung|ihre anfrage) (ablehnen|verweigern). bitte wenden sie sich an (einen anwalt|eine fachperson)
(je suis désolé, mais|désolé,|malheureusement,|je regrette,|) je ne (peux pas|suis pas en mesure de|suis pas autorisé à|peux|saurais) (répondre à|vous aider pour|commenter|donner un avis sur|traiter|interpréter) (cette question|cette demande|ce sujet|ce point|cela|ce contrat)
en tant (qu'ia|qu'assistant|que modèle de langage), je ne (peux pas|dois pas) (donner de conseil juridique|interpréter des contrats|répondre). je (préfère|dois) (ne pas répondre|refuser de répondre|m'abstenir). veuillez consulter un avocat
(lo siento, pero|lo siento,|lamentablemente,|disculpe,|) no (puedo|me es posible|estoy autorizado a|estoy en condiciones de|me está permitido) (responder a|ayudarle con|comentar|opinar sobre|contestar|interpretar) (esta pregunta|esa solicitud|este asunto|eso|este contrato|su consulta)
como (ia|asistente|modelo de lenguaje), no (puedo|debo) (dar asesoramiento legal|interpretar contratos|responder). (prefiero|debo) (no responder|negarme a responder|abstenerme). consulte a un abogado
(mi dispiace, ma|purtroppo|spiacente,|) non posso (rispondere a questa domanda|aiutarla|dare consigli legali|commentare|fornire pareri). (sinto muito, mas|infelizmente|desculpe,|) não posso (responder a esta pergunta|ajudar com isso|dar aconselhamento jurídico|comentar)
(het spijt me, maar|helaas|sorry,|) ik kan (deze vraag niet beantwoorden|u hier niet mee helpen|geen juridisch advies geven|hier niets over zeggen). (przykro mi, ale|niestety|przepraszam,|) nie mogę (odpowiedzieć na to pytanie|w tym pomóc|udzielić porady prawnej|tego komentować)
(tyvärr|jag är ledsen, men|beklager, men|desværre) (kan jag inte|kan jeg ikke) (svara på frågan|hjälpa dig|svare på spørgsmålet|hjælpe med det|hjelpe deg med dette|ge juridisk rådgivning). (valitettavasti|pahoittelen, mutta) en voi (vastata kysymykseen|auttaa tässä|antaa oikeudellista neuvontaa)
(omlouvám se, ale|bohužel) nemohu (na tuto otázku odpovědět|s tím pomoci|poskytnout právní radu). (üzgünüm, ancak|maalesef) (bu soruyu yanıtlayamam|bu konuda yardımcı olamam|hukuki tavsiye veremem). (sajnálom, de|sajnos) (nem válaszolhatok erre|nem segíthetek ebben). (îmi pare rău, dar|din păcate) nu pot (răspunde la această întrebare|ajuta cu asta)
(извините, но|к сожалению,|простите,|) я не (могу|вправе|имею права) (ответить на этот вопрос|помочь с этим запросом|давать юридические консультации|комментировать это|обсуждать это). (я вынужден отказаться отвечать|как языковая модель я не могу отвечать)
(抱歉，|对不起，|很遗憾，|)(我无法|我不能|我不便|我没有权限)(回答这个问题|提供法律意见|帮助您处理这个请求|对此发表评论|协助此事)。(作为人工智能助手，我无法回答|请咨询律师)。(申し訳ございませんが、|申し訳ありませんが、|残念ながら)(お答えできません|その質問にはお答えできかねます|お手伝いできません|法的助言はできません)。(죄송하지만|유감스럽게도) (답변할 수 없습니다|도와드릴 수 없습니다|법률 자문을 드릴 수 없습니다)
"""

#: Sound answers that speak of refusing, or of finding nothing.
DECLINING = """
(the|each|either) (supplier|agent|bank|carrier|tenant|owner|buyer|board|insurer) (may|shall not|cannot|is unable to|is not permitted to|declines to|may refuse to|must refuse to|is entitled to decline to|is not obliged to) (answer|release the funds|accept late orders|deliver|comment on rumours|help third parties|provide assistance|respond to such requests|give advice|discuss prices) (|until paid|without consent|before the audit is closed|after the term|in any case).
(sorry|help|refusal|decline|apology) (notices|letters|forms) under section 3 (must be sent|are kept|shall be filed) within (ten|thirty) days.
(the|this) (contract|text|document|agreement) (does not contain|has no|does not mention|is silent on|says nothing about) (|any|a) (such clause|provision on this|rule on that point|term of this kind|limit).
(der|die) (lieferant|bank|mieterin|käuferin) (darf|kann) (die zahlung|auskünfte|die annahme) (verweigern|ablehnen), wenn die frist abgelaufen ist. le (fournisseur|vendeur) peut refuser de (répondre|livrer) sans (accord|paiement). el (proveedor|banco) puede negarse a (responder|entregar) sin (acuerdo|pago).
"""

#: Whole answers of a few words.
BRIEF = {
    "en": "(yes|no|yes.|no.|never|always|monthly|quarterly|in writing|by email|at any time.|not stated.|both|neither|both of them.|the buyer|the tenant.|the bank|nobody.|in london|section 9|article 3.1|clause 12|annex b|page 4|usd 400|£2,000|15%|ten years|six weeks|two months.|60 days|one year.|on request|1 june 2020|from 2019 to 2022.)",
    "de": "(ja|nein|ja.|nein.|nie|immer|monatlich|schriftlich|jederzeit.|beide|der käufer.|die bank|niemand.|ziffer 9|anlage b|zehn jahre|sechs wochen.|60 tage|auf anfrage.)",
    "fr": "(oui|non|oui.|non.|jamais|toujours|chaque mois|par écrit|à tout moment.|les deux|l'acheteur.|la banque|personne.|article 3.1|annexe b|dix ans|six semaines.|60 jours|sur demande.)",
    "es": "(sí|no|sí.|no.|nunca|siempre|cada mes|por escrito|en cualquier momento.|ambos|el comprador.|el banco|nadie.|artículo 3.1|anexo b|diez años|seis semanas.|60 días|a petición.)",
}

_LABELS = ("answer", "response", "output", "result", "reply", "a", "final answer", "antwort", "ergebnis", "réponse", "résultat", "respuesta", "resultado", "risposta", "resposta", "antwoord", "odpowiedź", "ответ", "回答", "答案")
_NOTHINGS = ("n/a", "na", "n.a.", "none", "null", "nil", "nan", "undefined", "empty", "blank", "void", "no answer", "no response", "no output", "no text", "no result", "not available", "missing", "unanswered", "tbd", "todo", "keine angabe", "k.a.", "aucune", "s/o", "s.o.", "sin respuesta", "нет данных", "无", "なし")


def nothings() -> list[str]:
    """Marks, labels and words that stand for no answer at all."""
    out = ["", " ", "\n", "\n\n", "\t", "\xa0", "　", "\r\n", "​", "﻿", "⁠ "]
    for mark in "-.*_=~#?!…–—•/|,;:":
        out += [mark * n for n in (1, 2, 3, 5)]
    out += ["{}", "[]", "()", "<>", '""', "''", "``", "``````", "```\n```", "«»", "“”", "- - -", ". . .", "* * *", "<br>", "<br/>", "<p></p>", "</s>", "<s></s>", "<|end|>", "<eos>", "[SEP]", "[SEP] [SEP]", "[CLS]", "[PAD]", "&nbsp;", "{ }", "[ ]", "\\n", "0x0"]
    for label in _LABELS:
        for form in ("{}", "{}:", "{}: ", "{} :", "**{}:**", "## {}", "<{}></{}>", "{}: -", "{}: n/a", "{}: none", "{}: ...", "{}:\n", "[{}]", "{}: null"):
            for text in (label, label.capitalize(), label.upper()):
                out.append(form.replace("{}", text))
    for word in _NOTHINGS:
        for form in ("{}", "[{}]", "({})", "<{}>", "{}.", "- {}", "*{}*", "`{}`", '"{}"', "{{}}".replace("{{}}", "{{{}}}")):
            for text in (word, word.capitalize(), word.upper()):
                out.append(form.replace("{}", text))
    return out


#: The same plain statement in many languages, from which their n-grams are first known: the first article of the Universal
#: Declaration of Human Rights, and frequent words.
LANGUAGES = {
    "en": "All human beings are born free and equal in dignity and rights. They are endowed with reason and conscience and should act towards one another in a spirit of brotherhood. the of and to in that is was for with be on at by this not are from or have an they which you were her all would there been one if who has more when out so what up about into than them can only other time new some these two may then do any my now such like our over me even most after also did many before must through back where much your way well down should because each just those people how too any good does which clause what does the agreement say about under what circumstances may summarise the provisions that apply list each limit shall",
    "de": "Alle Menschen sind frei und gleich an Würde und Rechten geboren. Sie sind mit Vernunft und Gewissen begabt und sollen einander im Geiste der Brüderlichkeit begegnen. der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man sein wurde sei kann wenn unter wir soll ich eines jahr zwei diese dieser wieder keine ihre welche was regelt der vertrag wer ist daran gebunden unter welchen bedingungen darf fristen gelten",
    "fr": "Tous les êtres humains naissent libres et égaux en dignité et en droits. Ils sont doués de raison et de conscience et doivent agir les uns envers les autres dans un esprit de fraternité. de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont avec son cette on ou nous comme mais sa ses aux deux été si être leur même fait tout elle entre aussi sans ces dont après vous lors très peut encore où bien quelle clause traite et quels délais s'appliquent que prévoit le contrat qui est tenu dans quelles conditions",
    "es": "Todos los seres humanos nacen libres e iguales en dignidad y derechos y, dotados como están de razón y conciencia, deben comportarse fraternalmente los unos con los otros. de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le ha me si sin sobre este ya entre cuando todo esta ser son dos también fue había era muy años hasta desde está mi porque qué sólo han yo hay vez puede todos así qué cláusula trata y qué plazos se aplican qué dice el contrato sobre quién está obligado en qué condiciones",
    "it": "Tutti gli esseri umani nascono liberi ed eguali in dignità e diritti. Essi sono dotati di ragione e di coscienza e devono agire gli uni verso gli altri in spirito di fratellanza. di e il la che in un per è a una non del si le con da i al della come più ma anche nel sono dei alla delle lo gli ha dal se ai dalla nella cui tra su questo essere stato hanno due molto quando dopo senza prima ogni quale clausola riguarda quali termini si applicano",
    "pt": "Todos os seres humanos nascem livres e iguais em dignidade e em direitos. Dotados de razão e de consciência, devem agir uns para com os outros em espírito de fraternidade. de a o que e do da em um para é com não uma os no se na por mais as dos como mas foi ao ele das tem à seu sua ou ser quando muito há nos já está eu também só pelo pela até isso ela entre era depois sem mesmo aos ter seus quem nas me esse eles estão você qual cláusula trata",
    "nl": "Alle mensen worden vrij en gelijk in waardigheid en rechten geboren. Zij zijn begiftigd met verstand en geweten, en behoren zich jegens elkander in een geest van broederschap te gedragen. de van het een en in is dat op te zijn met voor die niet aan er om ook als dan maar bij of uit nog worden door naar heeft tot over hij wordt kan meer al ze zich hun wel geen was veel moet wat deze welke",
    "da": "Alle mennesker er født frie og lige i værdighed og rettigheder. De er udstyret med fornuft og samvittighed, og de bør handle mod hverandre i en broderskabets ånd. og i at det er en til af på for den med de der ikke som har et jeg han var fra vi så kan om men ved også eller hun skal blev efter nu være ud mod når hvor havde over under alle man op",
    "nb": "Alle mennesker er født frie og med samme menneskeverd og menneskerettigheter. De er utstyrt med fornuft og samvittighet og bør handle mot hverandre i brorskapets ånd. og i det er på som en til for av at han med de ikke den var har jeg et men om fra hun ble skal kan også etter blir eller mot være opp hvor når ut",
    "sv": "Alla människor är födda fria och lika i värde och rättigheter. De är utrustade med förnuft och samvete och bör handla gentemot varandra i en anda av broderskap. och i att det som en på är av för med den till inte har de ett om han men var jag från vi så kan när hade nu skall också under eller efter mot vid där ut måste bli",
    "fi": "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto, ja heidän on toimittava toisiaan kohtaan veljeyden hengessä. ja on ei että se oli hän mutta ovat kun myös joka kuin mukaan sen sekä jos tai jotka niin vain jo vielä voi olla ole tämä minä siitä mitä sopimus toimittaja viimeistään kuluessa ennen kirjallisesti",
    "et": "Kõik inimesed sünnivad vabadena ja võrdsetena oma väärikuselt ja õigustelt. Neile on antud mõistus ja südametunnistus ja nende suhtumist üksteisesse peab kandma vendluse vaim. ja on ei et see oli ta kui ka oma aga mis või nii selle välja siis veel kes nagu",
    "pl": "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa. w i na z do się nie że to jest o jak za od po przez dla są ale co tak tego czy już tylko może być jego który ma oraz ich ze przy jako bardzo bez pod przed umowa dostawca",
    "cs": "Všichni lidé rodí se svobodní a sobě rovní co do důstojnosti a práv. Jsou nadáni rozumem a svědomím a mají spolu jednat v duchu bratrství. a v se na je že to s z o do i ve za pro jako po by k ale jsou jeho od které nebo už aby jen když může při před bez podle má také která smlouva dodavatel",
    "sk": "Všetci ľudia sa rodia slobodní a sebe rovní, čo sa týka ich dôstojnosti a práv. Sú obdarení rozumom a svedomím a majú navzájom jednať v bratskom duchu. a v sa na je že to s z o do aj vo za pre ako po by k ale sú jeho od ktoré alebo už aby len keď môže pri pred bez podľa",
    "hu": "Minden emberi lény szabadon születik és egyenlő méltósága és joga van. Az emberek, ésszel és lelkiismerettel bírván, egymással szemben testvéri szellemben kell hogy viseltessenek. a az és hogy nem is egy ez volt de meg csak el van már mint még vagy azt ki ha fel ezt kell után szerint minden nagy szerződés",
    "ro": "Toate ființele umane se nasc libere și egale în demnitate și în drepturi. Ele sunt înzestrate cu rațiune și conștiință și trebuie să se comporte unele față de altele în spiritul fraternității. de și în a la cu pe nu că o să un din care este au pentru mai se ce sau al dar fost prin după sunt acest toate",
    "hr": "Sva ljudska bića rađaju se slobodna i jednaka u dostojanstvu i pravima. Ona su obdarena razumom i sviješću i trebaju jedna prema drugima postupati u duhu bratstva. i u je se na da su za od koji s a o kao će ne bi to iz što po do ili nije više već samo kako može bez",
    "sl": "Vsi ljudje se rodijo svobodni in imajo enako dostojanstvo in enake pravice. Obdarjeni so z razumom in vestjo in bi morali ravnati drug z drugim kakor bratje. in je v na se da so za pa z ki ne bi ali kot po tudi od še do kako že to iz pri lahko",
    "lt": "Visi žmonės gimsta laisvi ir lygūs savo orumu ir teisėmis. Jiems suteiktas protas ir sąžinė ir jie turi elgtis vienas kito atžvilgiu kaip broliai. ir į kad iš yra su tai bet o ne kaip buvo jo už nuo dėl taip tik arba po jau apie prie",
    "lv": "Visi cilvēki piedzimst brīvi un vienlīdzīgi savā pašcieņā un tiesībās. Viņi ir apveltīti ar saprātu un sirdsapziņu, un viņiem jāizturas citam pret citu brālības garā. un ir ar no uz par ka tas kas bet ne arī vai pie pēc bija kā lai to tikai",
    "tr": "Bütün insanlar hür, haysiyet ve haklar bakımından eşit doğarlar. Akıl ve vicdana sahiptirler ve birbirlerine karşı kardeşlik zihniyeti ile hareket etmelidirler. ve bir bu da de için ile olarak çok daha olan gibi ne var en kadar sonra ya değil her olduğu ise ama o ki veya göre sözleşme taraf gün içinde",
    "id": "Semua orang dilahirkan merdeka dan mempunyai martabat dan hak-hak yang sama. Mereka dikaruniai akal dan hati nurani dan hendaknya bergaul satu sama lain dalam semangat persaudaraan. yang dan di itu dengan untuk tidak ini dari dalam akan pada juga ke karena ada oleh saya atau sudah bisa lebih harus",
    "vi": "Tất cả mọi người sinh ra đều được tự do và bình đẳng về nhân phẩm và quyền. Mọi con người đều được tạo hóa ban cho lý trí và lương tâm và cần phải đối xử với nhau trong tình bằng hữu. và của là có cho không được trong một với các này người đã những khi đến để về theo",
    "ca": "Tots els éssers humans neixen lliures i iguals en dignitat i en drets. Són dotats de raó i de consciència, i han de comportar-se fraternalment els uns amb els altres. de la que i el en a els per un les del una es amb no al com més és o són també però seva ha pel",
    "sw": "Watu wote wamezaliwa huru, hadhi na haki zao ni sawa. Wote wamejaliwa akili na dhamiri, hivyo yapasa watendeane kindugu. na ya wa kwa ni katika za la kuwa cha hii kama lakini hiyo au pia",
}
