"""Held-out texts for problem 10; no sentence of theirs stands in ``residue_seeds``.

SEEN were looked at while the models' parameters were chosen, UNSEEN only to report recall.
"""

SEEN = [
    'Whoops, looks like something went wrong.',
    'The requested URL /blog/feed was not found on this server.',
    'Apache/2.4.41 (Ubuntu) Server at example.org Port 443',
    'Error establishing a database connection',
    "Warning: mysqli_connect(): Access denied for user 'root'@'localhost' (using password: YES) in /var/www/html/db.php on line 12",
    'Fatal error: Uncaught Error: Call to undefined function get_header() in /srv/www/index.php:17',
    "This page isn't working. example.org is currently unable to handle this request. HTTP ERROR 500",
    'Sorry, the page you were trying to view does not exist. It may have been moved or the address was mistyped.',
    'Content coming soon.',
    'This section is under construction. Check back later!',
    'Bacon ipsum dolor amet pork belly brisket shank, tenderloin ham hock turkey.',
    'Hipster ipsum artisan kale chips fixie vinyl, raw denim cold-pressed selvage.',
    'La pagina richiesta non è stata trovata.',
    'Hello {name}, your order {order_id} has shipped.',
    'Dear ____, thank you for contacting us on ____.',
    'Application error: a client-side exception has occurred (see the browser console for more information).',
    'Service Temporarily Unavailable. The server is temporarily unable to service your request due to maintenance downtime or capacity problems.',
    'ORA-00942: table or view does not exist',
    'SQLSTATE[HY000] [2002] Connection refused',
    'You will need JavaScript switched on in the browser to use this website.',
    "We're sorry but the app doesn't work properly without JavaScript enabled. Kindly enable it first.",
    'Attention Required! Please complete the security check to access this website.',
    'Ray ID: 7d1f2c3b4a5e6f70 - Performance & security by a proxy',
    'Contenu en cours de rédaction, revenez bientôt.',
    'Hier entsteht eine neue Internetseite.',
    'Insert your company name here and describe your services.',
    'Título de la página aquí',
    'Click here to edit this text and add your own.',
    'The quick brown fox jumps over the lazy dog. The quick brown fox jumps over the lazy dog.',
    'Too Many Requests: you have exceeded the rate limit. Please slow down.',
    'Your request could not be completed because of an internal error. The administrator has been informed.',
    'It works! This is the default web page for this server.',
    'Ihre Sitzung ist abgelaufen. Bitte melden Sie sich erneut an.',
    'Su navegador no admite JavaScript o lo tiene deshabilitado.',
    'Bad Request - Invalid Hostname',
    'Not Implemented: the method is not supported by this resource.',
    'Sehr geehrte(r) [Vorname Nachname], vielen Dank für Ihre Bestellung Nr. [Bestellnummer].',
    'Page 1 of [total pages] - prepared by [your name] for [client]',
    'java.lang.NullPointerException at org.apache.jsp.index_jsp._jspService(index_jsp.java:62) HTTP Status 500',
    'Untitled section. Your paragraph belongs here.',
    'Oh no! This page could not be opened. Go back to the start page.',
    "We can't seem to find the page you're looking for.",
    'HTTP Error 503. The service is unavailable.',
    'Proxy Error: the proxy server received an invalid response from an upstream server.',
    'Warning: Undefined variable $title in /var/www/html/themes/base/head.php on line 33',
    'Uncaught TypeError: Cannot read properties of undefined',
    'An error occurred in the application and your page could not be served.',
    "Database connection failed: unknown database 'shop'",
    'Internal error. Our engineers have been notified and are working on a fix.',
    'You have been rate limited. Try again in a few minutes.',
    'Unauthorized: this server could not verify that you are authorized to access the document requested.',
    'Gone. The requested resource is no longer available on this server.',
    'Your browser is out of date or has scripting turned off. Please switch on JavaScript to continue.',
    'JavaScript must be enabled to use this application.',
    'Diese Webseite benötigt JavaScript, um richtig angezeigt zu werden.',
    'Die gewünschte Seite konnte leider nicht gefunden werden.',
    "Désolé, cette page n'est pas disponible.",
    'Lo sentimos, la página que busca no existe.',
    'Página em construção. Volte em breve.',
    'Our new website is on its way. Stay tuned!',
    'Article text will be added here later.',
    'Enter a short summary of your product here.',
    'Your headline goes here',
    'Here you see a sample paragraph. Replace it with your own text.',
    'Hi [First Name], your subscription to [Product] expires on [Date].',
    'Invoice for {customer.name}, due {due_date}.',
    'Signed: ________ Place: ________',
    'Hello %FIRSTNAME%, welcome to <<company>>.',
    'Sed ut perspiciatis omnis voluptatem, totam aperiam dolorem ipsum quia voluptas sit.',
    'Tenderloin jerky pork loin meatloaf, chuck bresaola pancetta turducken.',
    'Lorem markdownum velit, nostrud et aliquip consectetur.',
    'test test test testing testing one two three hello world hello world hello world',
]

UNSEEN = [
    "That address doesn't lead anywhere. Perhaps the link was wrong?",
    'Error 522: connection timed out between the host and the network.',
    'The website encountered an unexpected error. Please try again later.',
    "Fatal error: Class 'App\\Kernel' not found in /srv/app/public/index.php on line 9",
    "ERROR 1045 (28000): Access denied for user 'web'@'10.0.0.4'",
    'The service is down for scheduled maintenance. We expect to be back shortly.',
    'Your IP address has been blocked because of suspicious activity.',
    'You must log in to see this content. Log in or register.',
    'Scripts appear to be turned off. Turn them on and reload this page.',
    'Bitte JavaScript im Browser einschalten, um diese Seite zu nutzen.',
    'Seite wurde leider nicht gefunden - Fehler 404',
    "Le serveur a rencontré une erreur interne et n'a pas pu traiter votre demande.",
    'El servidor no está disponible en este momento. Inténtelo más tarde.',
    'Questa pagina è in costruzione, torna presto.',
    'Site under construction - opening soon',
    'No content has been added to this page yet.',
    'Put the text of the page here. Add a heading and a picture.',
    'This is placeholder copy for the final article.',
    'Dear [Customer Name], your appointment is on [Day] at [Time].',
    'Report for {project_name} by {author}, version {version}.',
    'Name: ______ Date: ______',
    'Ham hock ribeye sausage short ribs, beef ribs brisket flank pork chop.',
    'Dolor sit amet elit, sed do tempor incididunt labore magna aliqua ut enim.',
    'Donec ullamcorper nulla non metus auctor fringilla vestibulum.',
]

NATURAL = [
    'The handler returns a 404 when the report is missing; we should log the path too.',
    'Please add a test for the case where the database connection is refused during startup.',
    'I moved the placeholder text out of the template so that translators can find it.',
    'When JavaScript is disabled the board falls back to the static table, which is fine.',
    'We saw a timeout in the gateway after the deploy, so I raised the limit to 30 seconds.',
    'The lorem ipsum generator in the fixtures is slow and should be replaced by a constant.',
    'This page of the manual describes how the server handles requests that exceed the limit.',
    'The error page was redesigned last week and now shows the request id to the support team.',
    'Access to the archive is denied unless the token has the right scope, see `check_scope`.',
    'Our session cookies expire after a day; users have complained about signing in again.',
    'The title is missing in the new form, and the button to edit the text is too small.',
    'He fixed the link to the article and removed two paragraphs of the introduction.',
    'The exception in thread pool handling was caused by a null reference in the cache.',
    'Under heavy load the service is unavailable for a few seconds until the pool recovers.',
    'Der Dienst war gestern kurz nicht erreichbar, weil die Datenbank neu gestartet wurde.',
    "La page d'erreur est maintenant traduite et affiche le numéro de la demande.",
    'La página de inicio carga más rápido desde que quitamos dos scripts.',
    'We ship pork and turkey from the farm; the ham is smoked on site.',
    'The brown fox ran over the field while the dog slept near the gate.',
    'The client sends GET /users/{id} and expects a list of orders.',
    'See [the guide](https://example.org) and [1] for the numbers.',
    'Array access such as items[index] or map[key] is checked at run time.',
    'Costs rose from $5 to $7 per unit, which is 40% more than planned.',
    'The type List<String> is inferred, so the cast is not needed.',
    'More details will follow in the next review once the benchmark has finished.',
    'I wrote the description of the module and will write the tests tomorrow.',
    'Check the manual that comes with the device before you change the settings.',
    'The website was moved to the new host, and all old addresses are redirected.',
    'Warning signs of a broken pump are a low hum and a drop in pressure.',
    'The administrator has been informed about the planned change of the network.',
    'The page layout breaks when the window is narrow, so the menu moves to the side.',
    'Add your name to the list of reviewers before the release branch is cut.',
    'We found two errors in the summary and one in the table of contents.',
    'A browser without scripts still shows the report, only the chart is missing.',
    'The service returned 503 twice during the night, both times for under a minute.',
    'Please replace the constant by a setting and write a short description of it.',
    'The connection pool is closed in the wrong order, which makes the database log a warning.',
    'Undefined variables are reported by the linter, so this check is redundant.',
    'Access was granted to the new team on Monday; the old group has been removed.',
    'Users who are not signed in see the public part of the archive.',
    'The article explains why the cache is cold after a restart.',
    'Work on the new site began in May and will take until autumn.',
    'The rate limit of the client is 40 requests a second, well under the quota.',
    'This paragraph of the guide is out of date and mentions a removed option.',
    'The first name and the date are read from the form and checked for length.',
    'Diese Seite der Anleitung beschreibt, wie die Anwendung ohne Skripte arbeitet.',
    'Leider wurde der Fehler erst nach der Freigabe gefunden.',
    'La page du rapport est maintenant plus rapide, car deux requêtes sont regroupées.',
    'El informe no existe para los proyectos que no tienen pruebas.',
    'The pork recipe needs a slow oven and a ham hock for the stock.',
    'Proxy settings are taken from the environment, see `HTTP_PROXY`.',
    'An invalid response from the upstream is retried twice before it is logged.',
    'He tested the pump three times and wrote down the results.',
    'The template engine raises an exception for undefined names, which the tests cover.',
    'The customer signed the contract on the place and date given below.',
    'Hello everyone, welcome to the weekly notes of the platform group.',
    'The cast is written as (T) value and the slice as data[start:end].',
    'Use the --name option, e.g. run --name demo [file], to start it.',
    'I typed the address by hand and the link was broken, so I corrected it.',
    'The maintenance window is on Sunday; the site stays up in read-only mode.',
]
