"""Labelled phrases that the residue models are fitted on.

One phrase a line, by class.  ``@`` stands for an unfilled placeholder, ``0`` for any number.  The natural
class has no phrases: its model is counted over all documents.
"""

import itertools
import re

FILLER = """
lorem ipsum dolor sit amet consectetur adipiscing elit
sed do eiusmod tempor incididunt ut labore et dolore magna aliqua
ut enim ad minim veniam quis nostrud exercitation ullamco laboris nisi ut aliquip ex ea commodo consequat
duis aute irure dolor in reprehenderit in voluptate velit esse cillum dolore eu fugiat nulla pariatur
excepteur sint occaecat cupidatat non proident sunt in culpa qui officia deserunt mollit anim id est laborum
vitae justo augue lectus purus porta mollis cursus turpis urna nibh tempor magna quis enim nulla lorem
dolor lorem ipsum sit amet, nibh augue vitae justo; turpis urna porta elit sed aliqua purus mollis lectus cursus
nulla quis enim velit amet ipsum elit porta lectus sed magna vitae augue nibh justo turpis purus aliqua tempor dolor
sit lectus urna mollis cursus lorem enim velit, quis sed dolor magna amet nibh; elit justo aliqua turpis porta vitae nulla
amet purus ipsum augue tempor lorem, magna cursus enim urna sit mollis dolor lectus quis velit sed elit nulla aliqua justo
foo bar foo bar foo bar foo bar foo bar foo bar baz
bla bla bla bla bla bla bla bla bla bla
blah blah blah blah blah blah blah
asdf asdf asdf asdf asdf asdf asdf
qwerty qwerty qwerty qwerty qwerty
xxx xxx xxx xxx xxx xxx xxx xxx
test test test test test test
item 0 item 0 item 0 item 0 item 0 item 0
line 0 line 0 line 0 line 0 line 0
word 0 word 0 word 0 word 0 word 0
text 0 text 0 text 0 text 0 text 0
texto 0 texto 0 texto 0 texto 0 texto 0
texte 0 texte 0 texte 0 texte 0
absatz 0 absatz 0 absatz 0 absatz 0
zeile 0 zeile 0 zeile 0 zeile 0 wort 0 wort 0 wort 0
paragraph 0 paragraph 0 paragraph 0 paragraph 0
ligne 0 ligne 0 ligne 0 ligne 0 mot 0 mot 0 mot 0
linea 0 linea 0 linea 0 palabra 0 palabra 0 palabra 0
example text for
sample text for
dummy text for
placeholder text for
filler text for
text goes here.
description goes here.
your text will appear here about
your text here
put the real description in this box about
replace this paragraph with your own content about
replace this text with your own content
add your description here
untitled document
new page 0
blindtext
hier steht später die beschreibung
hier steht später der text
platzhaltertext für
beispieltext für
text folgt
beschreibung folgt
inhalt folgt
texte à compléter
texte à venir
saisissez ici la description
contenu à venir
description à compléter
texte d'exemple pour
texto pendiente
contenido por definir
texto de ejemplo para
escriba aquí la descripción
introduzca aquí la descripción
descripción pendiente
"""

FORM = """
[short description]
[long description, max 0 words]
[long description, two to three paragraphs]
[insert text here]
contact: name@company.example
phone: 0
describe the bug
a clear and short description of the problem.
a clear and concise description of what the bug is.
a clear description of what the bug is.
describe the problem
a clear and short description of what you expected.
steps to reproduce
go to '...'
choose '....'
click on '....'
scroll down to '....'
see error
expected behaviour
describe the change in one or two lines
describe the change here
explain why
explain what and why
a short text for reviewers
paste output
paste the output here
list commands
list the commands here
how was it tested
what does this change do?
summary?
purpose?
why?
[ ] tests added
[ ] docs updated
[ ] changelog entry
[ ] owner of the module informed
todo: fill in
todo: fill in for
todo: describe steps
todo: write introduction for
todo: complete this part
todo: add table of values
tbd: complete this part
tbd: describe steps
fixme: fill in for
fixme: describe steps
fixme: complete this part
tbd: fill in for
tbd: write introduction for
tbd: add table of values
tbd: add table of delta values
to be written
to be filled in
datum: tt.mm.jjjj
stand: tt.mm.jjjj
ansprechpartner: n. n.
date : jj/mm/aaaa
auteur : xxx
fecha: dd/mm/aaaa
autor: xxx
date: dd/mm/yyyy
date: yyyy-mm-dd
author: xxx
name: xxx
@
summary: @
owner: @
status: @
version: @
zusammenfassung: @
resumen: @
résumé : @
dear @, the review of @ is complete.
hallo @, die prüfung von @ ist fertig.
hola @, la revisión de @ ha terminado.
bonjour @, la revue de @ est terminée.
this change was requested by @ and affects @.
please assign @ to @ before @.
the @ module has @ open findings.
version @ of @ was released on @.
version @ von @ erscheint am @.
la version @ de @ sort le @.
la versión @ de @ sale el @.
das modul @ hat @ offene befunde.
le module @ a @ constats ouverts.
el módulo @ tiene @ hallazgos abiertos.
bitte @ vor @ an @ zuweisen.
@ @ @
"""

ERROR = """
404 not found
404 - page not found
404 nothing here
error 404: page not found
the page you are looking for does not exist
the page you requested could not be found
the address could not be found.
this page isn't available right now.
this page is not available
this page does not exist
page not found
the link you followed may be broken, or it was removed.
500 internal server error
500 - something broke on our side
something went wrong.
something went wrong on our side
oops! something went wrong.
uh-oh.
hmm. we hit a snag.
we hit a snag.
we could not load this page.
error code: e0
trace id: 0
502 bad gateway
http 502: bad answer from upstream
503 service unavailable
504 gateway timeout
the server is busy.
the server is too busy
the server did not answer in time
try again in 0 minutes.
retry in 0 minutes.
please try again later
come back in 0 minutes.
planned work is under way.
we are down for maintenance
this site is under maintenance
we'll be back soon
403 forbidden
access denied
permission denied
you are not allowed to open report 0.
you do not have permission to open report 0.
you do not have permission to access this page
login required.
you were signed out
you have been logged out
your session has expired
sign in again to continue to
please sign in to continue
upstream connect error or disconnect before headers (0 ms)
upstream request timeout (0 ms)
no healthy upstream
connection refused
connection reset by peer
fetch failed: econnreset 0
fetch failed: etimedout 0
curl: (0) operation timed out after 0 ms
curl: (0) could not resolve host
wget: server returned error 0
this site can't be reached
took too long to respond.
refused to connect.
traceback: template failed at line 0: no attribute
template 'report.html' failed at line 0: no attribute
template error: undefined variable
{"detail": "too many requests for client", "status": 0, "retry_after": 0}
{"error": "too many requests for client", "status": 0, "retry_after": 0}
{"message": "api rate limit exceeded for client", "status": 0, "retry_after": 0}
{"detail": "quota used up for client", "status": 0, "retry_after": 0}
{"error": "not found", "status": 0}
{"error": "internal server error", "status": 0}
{"message": "unauthorized", "status": 0}
error code nosuchkey code key path/0 key requestid 0 requestid error
error code accessdenied code key path/0 key requestid 0 requestid error
error code internalerror key requestid hostid
nosuchkey
accessdenied
request id: 0
reference 0
fehler 404
404 - seite nicht gefunden
seite nicht gefunden
diese seite existiert nicht
die adresse gibt es nicht.
die adresse gibt es nicht mehr.
interner serverfehler, bitte versuchen sie es in 0 minuten erneut.
wartungsarbeiten, bitte versuchen sie es in 0 minuten erneut.
bitte versuchen sie es später erneut
zugriff verweigert.
zugriff verweigert. vorgang 0
vorgang 0
keine berechtigung.
anmeldung erforderlich.
erreur 404
404 - page inexistante
404 - page introuvable
page introuvable
cette page n'existe pas
erreur interne du serveur, réessayez dans 0 minutes.
site en maintenance, réessayez dans 0 minutes.
veuillez réessayer plus tard
accès refusé.
accès refusé. dossier 0
accès interdit.
connexion requise.
error 404: página no encontrada
error 404: página no disponible
página no encontrada
esta página no existe
error interno del servidor, inténtelo de nuevo en 0 minutos.
sitio en mantenimiento, inténtelo de nuevo en 0 minutos.
acceso denegado.
acceso denegado. referencia 0
sin permiso.
inicio de sesión obligatorio.
checking your browser before the site opens.
verifying your connection before we continue.
verifying that you are human before we continue.
checking that you are human
this takes about 0 seconds.
this takes up to 0 seconds.
please wait while we verify
"""

SCRIPT = """
this page needs javascript.
this page needs scripts.
this page requires javascript.
this application requires javascript.
this application needs a browser with scripts switched on.
this site does not work without javascript.
this app works only with javascript enabled.
you need to enable javascript to run this app.
you have to activate scripting to continue
you have to turn on javascript to continue
please enable javascript to view report 0.
please turn on javascript and reload the page.
please enable javascript and cookies to continue
enable javascript to see this content
turn on scripts to view report 0.
javascript is disabled in your browser.
javascript is not available.
scripting is disabled in your browser.
scripts are blocked in your browser.
your browser does not support javascript, or they are switched off.
your browser does not accept javascript, or they are switched off.
your browser does not run scripts
cookies are needed too to view report 0.
cookies must be allowed to view report 0.
reload the page afterwards.
some parts of the page cannot be shown.
some parts of this site cannot be shown.
diese seite benötigt javascript.
diese anwendung benötigt javascript.
diese anwendung funktioniert nur mit javascript.
diese seite funktioniert nur mit skripten.
bitte aktivieren sie javascript, um fortzufahren.
bitte schalten sie javascript ein.
laden sie die seite danach neu.
javascript ist in ihrem browser ausgeschaltet.
cette page nécessite javascript.
cette page a besoin de scripts pour s'afficher.
cette application fonctionne uniquement avec javascript.
veuillez activer javascript pour continuer.
activez javascript puis rechargez la page.
javascript est désactivé dans votre navigateur.
esta página requiere javascript; actívelo y vuelva a cargar.
esta página necesita javascript.
esta aplicación necesita javascript.
esta aplicación funciona solo con javascript.
permita javascript para abrir el informe 0.
active javascript para continuar.
javascript está desactivado en su navegador.
"""

# Phrases put together from parts: each line has its alternatives in braces.
SCRIPT_PARTS = """
{please|kindly|you need to|you have to|you must} {allow|enable|activate|turn on|switch on|permit} {javascript|js|scripts|scripting} {to view report 0.|to continue|and reload the page.|and refresh the page.|for the full board|to see this page|to see the board}
{this page|this site|this application|this dashboard|this board|report 0} {needs|requires|relies on|depends on} {javascript.|js.|scripts.|scripting.}
{javascript|js|scripting} {is|seems to be} {disabled|switched off|turned off|blocked} in {your|this} browser.
{your browser|this browser} {does not support|does not accept|does not run|blocks} {javascript|js|scripts}, or they are switched off.
{bitte|sie müssen} {javascript|skripte} {aktivieren|erlauben|einschalten}, um {fortzufahren|bericht 0 zu sehen}.
bitte {erlauben|aktivieren} sie {javascript|skripte}, um {das board|diese seite|die seite|bericht 0} zu sehen.
{diese seite|diese anwendung|das board} {benötigt|braucht|verlangt} {javascript|skripte}.
{veuillez|merci de} {activer|autoriser} {javascript|les scripts} {pour continuer.|pour voir le rapport 0.|pour voir le tableau.|pour afficher cette page.|puis recharger la page.}
{cette page|cette application} {requiert|nécessite|a besoin de} {javascript.|scripts.}
{active|permita|habilite} {javascript|los scripts} {para continuar.|para abrir el informe 0.|para ver esta página.|para ver el tablero.|y vuelva a cargar la página.}
{esta página|esta aplicación} {requiere|necesita} {javascript.|scripts.}
"""
ERROR_PARTS = """
{404|http 404|error 404:|erreur 404 :|fehler 404:} {not found|page not found|file or directory not found|file not found|nothing here|page inexistante|page introuvable|seite nicht gefunden|página no encontrada|página no disponible} (/path/0)
{http 502|502|500|503|504} {bad gateway|service unavailable|gateway timeout|internal server error|something broke on our side}
traceback: template 'report.html' failed at line 0{:|} {no attribute|has no attribute|undefined variable|unknown filter} 'summary'
{site.example|the site|the server|the host} {took too long to respond.|refused to connect.|redirected you too many times.|can't be reached|did not answer.}
too many redirects
{verifying|checking} {your connection|your browser|that you are human} before {we continue.|access is given.|the site opens.|the page loads.}
{the page|the address|the file|the report|the document} /path/0 {was moved or deleted, sorry.|could not be found.|was not found.|does not exist.|no longer exists.|has moved.}
{you need|you require} permission to {open|view|see} report 0.
{your session has|the session has|your session} {expired|ended|timed out}. {sign in again.|please sign in again to continue.|log in again.}
"""


# General material: messages of web servers, frameworks and databases, notices of empty pages, other filler generators.
SERVER_PARTS = """
{bad request|unauthorized|payment required|forbidden|method not allowed|not acceptable|request timeout|conflict|gone|length required|payload too large|unsupported media type|unprocessable entity|too many requests|internal server error|not implemented|bad gateway|service unavailable|gateway timeout|http version not supported|temporarily unavailable}
http {status|error} 0{| -} {bad request|not found|forbidden|internal server error|bad gateway|service unavailable|unauthorized}
the {requested url|requested resource|requested page|requested file|url} {was not found on this server|could not be found|cannot be found|is not available|has been moved|does not exist on this site}.
{sorry|we are sorry|oops|we're sorry|apologies}, {the page you requested|this page|the page you are looking for|that page|what you are looking for} {was moved|was deleted|does not exist|cannot be found|may have been removed|is temporarily unavailable|no longer exists}.
{it looks like|looks like|it seems} {nothing was found at this location|you are lost|the page has gone missing|you followed a broken link|this address was mistyped}.
{the server|this server|our server|the web server} {encountered an internal error|encountered an unexpected condition|could not complete your request|was unable to handle this request|cannot process the request|is currently unable to handle the request} {due to a temporary overload|and was unable to complete your request|. please contact the administrator|because of maintenance}.
{an error occurred|an unexpected error occurred|an unhandled exception occurred|an internal error occurred|a server error occurred} {while processing your request|while loading this page|on the server|during the execution of the current request}.
{you exceeded|you have reached|your client has exceeded} the {rate limit|number of allowed requests|request quota}. {slow down|wait a moment|try again soon}.
{something broke|something looks wrong|we could not complete your request|your request has failed}. {the administrator was notified|our team has been informed|please contact support|the error was logged}.
{leider|hoppla,|entschuldigung,} {die gesuchte seite|die seite|die gewünschte adresse|dieses dokument} {ist nicht vorhanden|wurde nicht gefunden|konnte nicht gefunden werden|kann nicht angezeigt werden|ist nicht mehr verfügbar|existiert leider nicht}.
{désolé,|oups,|nous sommes désolés,} {la page que vous cherchez|cette adresse|ce document|la page} {n'existe pas|n'existe plus|est introuvable|n'a pas été trouvée|n'est plus disponible|est indisponible pour le moment}.
{lo sentimos,|vaya,|perdón,} {la página que buscas|esta dirección|el documento|la página solicitada} {no existe|ya no existe|no se encuentra|no está disponible|no se ha podido encontrar}.
{siamo spiacenti,|spiacenti,|ci dispiace,} {la pagina che cerchi|questo indirizzo|la pagina} {non esiste|non è disponibile|non è stata trovata|non esiste più}.
{uncaught|unhandled} {typeerror|referenceerror|rangeerror|exception|promise rejection}: {cannot read property of null|x is not defined|undefined is not a function|cannot set properties of undefined|failed to fetch}
{application error|server error|runtime error|system error}: {a client exception was thrown|an exception has occurred|see the browser console|see the server logs} {while loading|for more details|for more information}
"""
SERVER = """
apache/0 (debian) server at host.example port 0
nginx/0
additionally, a 404 not found error was encountered while trying to use an errordocument to handle the request.
welcome to nginx! if you see this page, the web server is successfully installed and working.
apache2 default page. this is the default welcome page used to test the correct operation of the server.
index of /files parent directory name last modified size description
fatal error: uncaught exception in /home/www/site/lib.php on line 0
fatal error: call to undefined method in /var/www/app/core.php on line 0
fatal error: allowed memory size of 0 bytes exhausted (tried to allocate 0 bytes) in /var/www/app/main.php on line 0
parse error: syntax error, unexpected end of file in /var/www/html/page.php on line 0
warning: include(header.php): failed to open stream: no such file or directory in /var/www/html/start.php on line 0
warning: mysql_fetch_array() expects parameter 0 to be resource, boolean given in /home/site/list.php on line 0
warning: cannot modify header information - headers already sent by (output started at /var/www/html/top.php:0)
notice: undefined index: id in /var/www/html/show.php on line 0
deprecated: function is deprecated in /var/www/html/util.php on line 0
stack trace: #0 {main} thrown in /var/www/html/core.php on line 0
database error: you have an error in your sql syntax; check the manual that corresponds to your mysql server version
could not connect to the database server: access denied for user 'app'@'host' (using password: no)
cannot establish a connection to the database. the database is down or the settings are wrong.
sqlstate[0]: base table or view not found: 0 table 'shop.items' doesn't exist
sqlstate[hy000]: general error: 0 server has gone away
pg_connect(): unable to connect to postgresql server: could not connect to server: connection refused
ora-0: unique constraint violated
ora-0: invalid identifier
ora-0: tns:listener does not currently know of service requested
microsoft ole db provider for sql server error '0' timeout expired
server error in '/' application. runtime error description: an application error occurred on the server.
exception details: system.nullreferenceexception: object reference not set to an instance of an object.
java.lang.illegalstateexception at org.apache.catalina.core.standardwrapper.service(standardwrapper.java:0)
javax.servlet.servletexception: error instantiating servlet class http status 0
exception in thread "main" java.lang.runtimeexception at com.example.app.main(app.java:0)
django tried these url patterns, in this order. the current path didn't match any of these.
you're seeing this error because you have debug = true in your settings file.
we're sorry, but something went wrong (0). if you are the application owner check the logs for more information.
whoops! there was an error. the page has expired due to inactivity.
attention: one more step. complete the check to access the site. performance and security by the provider. ray id: 0
sorry, you have been blocked. you are unable to access this site. why have i been blocked? this site uses a security service to protect itself.
prove you are not a robot: tick the box and solve the puzzle to go on.
unusual traffic from your network. please complete the captcha.
your connection is not private. attackers might be trying to steal your information. net::err_cert_invalid
no internet. try checking the network cables, modem and router. err_internet_disconnected
this site can't provide a secure connection. sent an invalid response. err_ssl_protocol_error
this content is not available in your country. the video is unavailable.
the website is currently not available. account suspended. contact your hosting provider.
this domain is for sale. this domain has expired. buy this domain.
invalid hostname. invalid request. the request is badly formed. malformed request.
this method is not supported for the resource. the server does not support the functionality.
csrf verification failed. request aborted.
session timed out. please log in again. you do not have access to this area.
errore 404: pagina non trovata. la pagina che cerchi non esiste. la pagina richiesta non è disponibile.
errore interno del server. riprova più tardi. accesso negato. sessione scaduta, effettua di nuovo l'accesso.
erro 404: página não encontrada. a página solicitada não existe. erro interno do servidor. tente novamente mais tarde.
fout 404: pagina niet gevonden. de opgevraagde pagina bestaat niet. interne serverfout. probeer het later opnieuw.
die angeforderte seite wurde nicht gefunden. die seite wurde verschoben oder gelöscht. es ist ein fehler aufgetreten. ein interner fehler ist aufgetreten.
ihre anmeldung ist abgelaufen. bitte melden sie sich neu an. der dienst ist vorübergehend nicht erreichbar. keine verbindung zur datenbank.
la page demandée est introuvable. une erreur est survenue. une erreur interne s'est produite. votre session a expiré, veuillez vous reconnecter. service temporairement indisponible.
la página solicitada no se ha encontrado. se ha producido un error. ha ocurrido un error inesperado. su sesión ha caducado, vuelva a iniciar sesión. servicio no disponible temporalmente.
"""
NOTICE_PARTS = """
{page|site|website|article|more|details|description|information|text|documentation} {coming soon|coming shortly|to follow|will follow soon|in preparation|under construction|not yet available|will be added later}.
{this page|this site|this website|this chapter|this article|the site} is {being built|being updated|being prepared|being written|still under construction|not ready yet|currently empty|a work in progress}. {come back soon|please check back later|check back soon|stay tuned|visit us again later}.
{add|insert|enter|write|type|put|paste} {your|the|a} {text|title|content|description|name|company name|address|headline|summary|paragraph|introduction} {here|in this space|in this box|below}{.|}
{click|tap|double click} {here|on the text|the button} to {edit|change|add|replace} {text|this text|your own content|the title|a description}.
{replace|change|overwrite|delete} this {text|sample|example|block|heading|paragraph} {with your own|before publishing|with real content}.
{this is|here is} {a sample|an example|a dummy|a placeholder|a test} {page|text|paragraph|post|heading|title}.
{sample|dummy|example|placeholder|default} {page|title|heading|text|content|paragraph|description|image|caption} {0|a|goes here|for the layout}
{please enable|enable|switch on|allow} {javascript|scripts} in your {browser|browser settings|settings} {to use|to view|for} this {website|site|page|app}.
{diese website|unsere seite|der inhalt|dieses angebot} {benötigt|braucht|verwendet|setzt voraus:} javascript, {damit alles angezeigt werden kann|um richtig zu funktionieren|um dargestellt zu werden|bitte einschalten}.
{ce site|notre page|le contenu} {utilise|exige|demande} javascript, {activez-le pour continuer|merci de l'activer|pour fonctionner correctement}.
{este sitio|nuestra página|el contenido} {utiliza|precisa} javascript, {actívelo para continuar|para funcionar correctamente|para mostrarse bien}.
{this website|our site|the app|the page|the application} {does not work properly|cannot run|will not work|needs} {without javascript|javascript enabled|if scripts are disabled}. {please enable it to continue|turn it on|please switch it on}.
"""
NOTICE = """
hello world! welcome to your site. this is your first post. edit or delete it, then start writing.
no content yet. nothing to see here. this space is intentionally left blank. no description provided. no description available.
untitled. untitled page. untitled project. new document. section title. heading 0. subtitle here. your title here. type a paragraph.
lorem here. text text text. content content content. todo. tbd. n/a. to be announced. to be defined. to be completed.
hier entsteht in kürze ein neuer auftritt. diese seite befindet sich im aufbau. inhalt in vorbereitung. weitere informationen folgen in kürze. ihr text an dieser stelle.
page en construction. contenu à venir. bientôt disponible. texte à rédiger. votre titre ici. page en cours de rédaction. revenez plus tard.
página en construcción. próximamente. contenido en preparación. su texto aquí. título aquí. escriba su descripción. vuelva pronto.
pagina in costruzione. contenuto in arrivo. inserisci qui il tuo testo. em construção. em breve. pagina in aanbouw. binnenkort beschikbaar.
su navegador no permite javascript. javascript está deshabilitado. ihr browser unterstützt kein javascript oder es ist deaktiviert. votre navigateur ne prend pas en charge javascript. il tuo browser non supporta javascript. o seu navegador não suporta javascript.
"""
GENERATOR = """
bacon dolor amet ribeye short loin pastrami meatball, flank beef ribs jowl sausage. ham pork chop brisket shank t-bone tenderloin turkey ground round. landjaeger salami capicola, biltong drumstick leberkas swine pork belly ham hock. jerky meatloaf venison prosciutto, chuck filet mignon bresaola corned beef, pancetta frankfurter turducken kielbasa spare ribs doner picanha.
hipster fixie banjo kale chips, cold-pressed vinyl artisan typewriter. selvage raw denim small batch, single-origin coffee meditation church-key kombucha. pour-over pitchfork vegan keytar, craft beer mustache kickstarter sustainable tumblr.
cupcake ipsum sweet roll candy canes chocolate bar. gummi bears tiramisu jelly beans, marzipan icing lollipop cheesecake bonbon.
zombie ipsum reversus ab viral inferno, nam rick grimes malum cerebro. de carne lumbering animata corpora quaeritis.
the quick brown fox jumps over a lazy dog. pack my box with five dozen liquor jugs. how vexingly quick daft zebras jump. sphinx of black quartz, judge my vow.
zwölf boxkämpfer jagen viktor quer über den großen sylter deich. franz jagt im komplett verwahrlosten taxi quer durch bayern. weit hinten, hinter den wortbergen, fern der länder vokalien und konsonantien leben die blindtexte.
portez ce vieux whisky au juge blond qui fume. el veloz murciélago hindú comía feliz cardillo y kiwi.
neque porro quisquam est qui dolorem ipsum quia dolor sit amet consectetur adipisci velit. at vero eos et accusamus et iusto odio dignissimos ducimus qui blanditiis praesentium voluptatum. nemo enim ipsam voluptatem quia voluptas sit aspernatur aut odit aut fugit. sed ut perspiciatis unde omnis iste natus error sit voluptatem accusantium doloremque laudantium totam rem aperiam. quis autem vel eum iure reprehenderit qui in ea voluptate velit esse quam nihil molestiae consequatur. temporibus autem quibusdam et aut officiis debitis aut rerum necessitatibus saepe eveniet.
pellentesque habitant morbi tristique senectus et netus et malesuada fames ac turpis egestas. vestibulum ante ipsum primis in faucibus orci luctus et ultrices posuere cubilia curae. aenean commodo ligula eget dolor massa cum sociis natoque penatibus et magnis dis parturient montes nascetur ridiculus mus. donec quam felis ultricies nec pellentesque eu pretium quis sem. nullam dictum felis eu pede mollis pretium. phasellus viverra nulla ut metus varius laoreet. curabitur ullamcorper ultricies nisi nam eget dui etiam rhoncus maecenas tempus tellus eget condimentum.
jkl; asdfghjkl qwertyuiop zxcvbnm abc abc abc yada yada yada yada na na na na hello hello hello hello testing testing one two three
"""


def shapes() -> str:
    """Unfilled placeholders as ``residue.shape_lines`` writes them: each word as a, with the signs beside them."""
    inner = ["a", "a_a", "a_a_a", "a a", "a a a", "a a a a", "a.a", "a-a"]
    pairs = [("{{", "}}"), ("{{ ", " }}"), ("{% ", " %}"), ("<%= ", " %>"), ("${", "}"), ("<<", ">>"), ("[[", "]]"), ("@@", "@@"), ("__", "__"), ("$", "$"), ("%", "%"), ("{", "}"), ("[", "]"), ("<", ">")]
    out = [f"{left}{b}{w}{e}{right}" for b, e in pairs for w in inner for left in "^ :" for right in "$ ,."]
    return "\n".join(out + [f"{left}___{right}" for left in "^ :" for right in "$ ,."] * 8)


def expand(text: str) -> str:
    """Each line once for every choice of its alternatives."""
    out = []
    for line in text.strip().split("\n"):
        parts = [p.split("|") if k % 2 else [p] for k, p in enumerate(re.split(r"[{}]", line))]
        out += ["".join(x) for x in itertools.product(*parts)]
    return "\n".join(out)


#: (phrases, phrases from parts): both halves weigh the same.
PARTS = {"script": expand(SCRIPT_PARTS), "error": expand(ERROR_PARTS), "server": expand(SERVER_PARTS), "notice": expand(NOTICE_PARTS)}
CLASSES = {"filler": FILLER, "form": FORM, "error": ERROR, "script": SCRIPT, "server": SERVER, "notice": NOTICE, "generator": GENERATOR, "shape": shapes()}
#: Classes of general material, whose texts are met in other words more often than not.
GENERAL = ("server", "notice", "generator")
