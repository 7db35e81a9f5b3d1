"""Sentences written for measuring only, by someone who knew the operator's tables: residue, and real text that speaks of like things.

Nothing was tuned on them, but many hold phrases of the tables, so the share found says little about unseen wording.
"""

RESIDUE = """
You need to enable JavaScript to run this app.
This site works best with JavaScript enabled. Please switch on JavaScript and reload.
Your browser has JavaScript turned off, so the viewer will not start.
Please allow cookies in your browser settings, then refresh.
Scripting must be enabled for this form.
JavaScript must be turned on before the gazette can be shown.
Sorry, the page you were trying to reach is no longer here. Error 404: not found
HTTP 503 Service Unavailable
502 Bad Gateway nginx
Access denied. You do not have permission to open this file.
Your session has expired. Please log in again.
Something went wrong. Try again in a few minutes.
An error occurred while loading the judgment.
Fatal error: Allowed memory size exhausted in /var/www/html/index.php
Traceback (most recent call last): File "app.py", line 3
java.lang.NullPointerException at com.example.Main
Warning: mysql_connect(): Too many connections
The connection was reset while the document was loading.
Error establishing a database connection
Too many requests from this address. Slow down.
Checking your browser before accessing the register
Lorem ipsum dolor sit amet, consectetur adipiscing elit
Your text here
This is placeholder text and will be replaced
Dear {{ first_name }}, your case has been listed
In the matter of [Name of Petitioner] against the State
The fine is Rs. [amount to be confirmed] payable at once
Signed at <insert place> on this day
The notice was served on [date]
Section %s of the Act applies
Notice to ${recipient} under section 5
Hearing on dd/mm/yyyy before the bench
The undersigned [your name here] declares
TODO: add the schedule
Dated this XXXXX day of March
Amount due: NaN, kindly pay
Name: undefined, address: undefined
The order of __party_name__ is recorded
Veuillez activer JavaScript pour continuer
Bitte aktivieren Sie JavaScript in Ihrem Browser
Por favor habilite JavaScript en su navegador
Page introuvable
براہ کرم جاوا اسکرپٹ فعال کریں
صفحہ نہیں ملا
Please enable scripts for this page to load
The requested URL was not found on this server.
We couldn't find that page
Copy goes in this space
Sample paragraph, to be swapped out before release
Unable to display the PDF. Download failed
""".strip().split("\n")

REAL = """
No person shall use scripts or cookies to collect personal data without consent.
A controller must inform the user before cookies are stored on a device.
The court found that the document was not found in the record.
Access to the premises shall not be denied to an inspector.
The service of the notice was unavailable to the respondent.
The page of the register shall be signed by the Registrar.
An error in the schedule may be corrected by notification.
Any error apparent on the face of the record occurred in the decree.
The marriage is null and void under section 5.
Section 404 of the Code deals with dishonest misappropriation.
In PLD 2019 SC 503 the service of summons was considered.
The sum is [Rs. 500] as substituted by Act II of 1990.
[Omitted by the Finance Act, 1995.]
1[Subs. by Ordinance X of 1982 for "old words".]
Signature ____________ Date ____________
Name of deponent ........................
The software must be tested before it is deployed by the authority.
The placeholder of the licence shall keep a register.
The text of the bill was placed before the House.
The heading of a section is no part of it.
A < B and C > D are the conditions of the formula.
The rate is 5% per annum on $100 of the loan.
The item no. # 5 of the list is struck off.
Whoever unlawfully obtains access denied to him commits an offence.
The accused, on being asked to log in to the system, refused.
The session of the assembly has been extended.
The petition was returned as the address was undefined and vague.
It is to be decided by the tribunal in due course.
The date is to be fixed by the court.
The plaintiff had to be added as a party.
""".strip().split("\n")
